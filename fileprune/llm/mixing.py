"""Mixing sources to target weights by systematic sampling.

Each source has a target; its documents are expected target / source_size times each. The expected copies are summed up
from the largest document to the smallest, one random offset (seeded, of the source) is added, and a document is emitted
once for every integer that its step of the sum crosses. Documents that share a step r have the sums k * r, so a
document's rank in its source is all that it needs.

A few very large documents can move a source's words by more than all the others. So the LARGEST ones are
drawn first, and the others share what those leave over of the target: their step is (target - words taken) / (words of the
others), on average over offsets the same as before. As documents come in the order of size, the words taken miss the target by
no more than the size of the largest of the others, unless these can't make up for the rest: their step lies between 0 and MOST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileprune.llm.common import global_rank, unused, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No target exceeds so many times its source's size, so no document is taken more often.
MOST = 3
#: Documents of each source that are drawn before the others' step is set, a quarter of the source's at most.
LARGEST = 64
SEED = 9
#: The plan, a row of some 60 bytes for each source, is broadcast up to so many sources; beyond, it is joined by its key.
BROADCAST_SOURCES = 50_000


def offset(key: Column, seed: int) -> Column:
    """A source's random offset in [0, 1), from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST, total_share: float = 1.0) -> DataFrame:
    """(key, source_size, n) with weight, target and first, the rank of the source's first document.

    A source is held at ``most`` times its size if the weighted share of what the sources held before it leave over
    exceeds that; sources are tried in the order of most * size / weight, which gives the fixed point of resharing at
    once. One row a source is all that these windows see.
    """
    by_key = Window.orderBy("key")
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    base = sizes.select(
        "key", "source_size", "n",
        F.element_at(pattern, ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.sum("n").over(by_key) - F.col("n")).alias("first"),
    )
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    tried = Window.orderBy("_ratio", "key")
    before = tried.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        base.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_share", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("_held", F.col("_share") > F.col("_ratio"))
    )
    free = F.when(~F.col("_held"), F.col("_share"))
    final = F.first(free, ignorenulls=True).over(tried.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shared = level.withColumn("_final", final)
    target = F.when(F.col("_held"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_final")))
    return shared.select("key", "source_size", "n", "weight", "first", target.cast("double").alias("target"))


def _crossed(begin: Column, step: Column, k: Column) -> Column:
    """Integers in (begin + step * k, begin + step * (k + 1)]; k counts from 0."""
    return (F.floor(begin + step * (k + F.lit(1.0))) - F.floor(begin + step * k.cast("double"))).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = SEED, total_share: float = 1.0) -> DataFrame:
    """``docs`` (source, doc_id, size and any others but those named here) with source_size, target and copies.

    Documents of size 0 may be emitted, taking no words; a null source is a source of its own, the last in order; a
    source without words gets target 0 and is not emitted. Repeated rows count each. Reruns agree: rows tie only if doc_id,
    size and source are equal.
    """
    keyed = docs.withColumn("_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))))
    ranked = global_rank(keyed, [F.col("_key").asc(), F.col("size").desc(), F.col("doc_id").asc_nulls_first()], "mixing", "_rank")
    sizes = ranked.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(sizes, weights, most, total_share)
    plan = plan.withColumn("step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", offset(F.col("key"), seed))
    plan = written(plan.select(F.col("key").alias("_key"), "source_size", "target", F.col("first").alias("_first"), F.least(F.lit(LARGEST), F.floor(F.col("n") / 4)).cast("long").alias("_large"), F.col("step").alias("_step"), F.col("offset").alias("_offset")), "mixing-plan")
    sent = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda x: x
    at = F.col("_rank") - F.col("_first")
    least = lambda copies: F.least(copies, F.lit(int(most)).cast("long"))
    first_copies = least(_crossed(F.col("_offset"), F.col("_step"), at))
    drawn = ranked.join(sent(plan), "_key").where(at < F.col("_large")).groupBy("_key").agg(F.sum(first_copies * F.col("size")).alias("_taken"), F.sum("size").alias("_drawn"))
    plan = plan.join(drawn, "_key", "left").fillna(0, ["_taken", "_drawn"])
    left = F.col("source_size") - F.col("_drawn")
    others = F.when(left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.col("_taken")) / left))).otherwise(F.col("_step"))
    plan = written(plan.withColumn("_others", others).drop("_taken", "_drawn"), "mixing-steps")
    then = least(_crossed(F.col("_offset") + F.col("_step") * F.col("_large").cast("double"), F.col("_others"), at - F.col("_large")))
    out = ranked.join(sent(plan), "_key").withColumn("copies", F.when(at < F.col("_large"), first_copies).otherwise(then))
    return out.drop("_key", "_rank", "_first", "_large", "_step", "_offset", "_others")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of all ``docs``; the text is counted where it is read, once, and not moved."""
    narrow = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    return mix(narrow).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as it is taken.

    What is ranked is a narrow table; rows meet their copies by a 128-bit hash of the whole row. Rows equal in every
    column are emitted as often as they are taken together.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    one, two, copies, time = (unused(docs, x) for x in ("_one", "_two", "_copies", "_time"))
    marked = docs.withColumn(one, F.xxhash64(F.lit(1), *whole)).withColumn(two, F.xxhash64(F.lit(2), F.reverse(F.col("text")), *reversed(whole)))
    narrow = marked.select(F.col(one).alias("one"), F.col(two).alias("two"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    taken = mix(written(narrow, "mixing-sizes")).groupBy("one", "two").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias("n"))
    taken = written(taken.where(F.col(copies) > 0).withColumnsRenamed({"one": one, "two": two}), "mixing-copies")
    found = marked.join(taken.where("n = 1").drop("n"), [one, two])
    if not (repeated := taken.where("n > 1").drop("n")).isEmpty():
        found = found.unionByName(marked.join(repeated, [one, two]).dropDuplicates([one, two]))
    return found.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*whole)


#: The same for DuckDB.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM d GROUP BY source
), t AS (
  SELECT *, {float(MOST)}::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights FROM s
), u AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS share, cap / weight AS ratio,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS tried
  FROM t WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, arg_min(CASE WHEN share <= ratio THEN share END, CASE WHEN share <= ratio THEN tried END) OVER () AS final FROM u
), p AS (
  SELECT source, source_size, n, CASE WHEN share > ratio THEN cap ELSE least(cap, weight * final) END AS target FROM v
), r AS (
  SELECT d.*, p.source_size, p.target, least({LARGEST}, p.n // 4) AS large, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS step,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) - 1 AS k,
         md5('{SEED}:' || CASE WHEN d.source IS NULL THEN '1' ELSE '0' || d.source END) AS h
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), o AS (
  SELECT *, list_sum([(instr('0123456789abcdef', substr(h, i, 1)) - 1) * 16::DOUBLE ** (8 - i) for i in range(1, 9)]) / 4294967296 AS u FROM r
), f AS (
  SELECT *, least(floor(u + step * (k + 1.0::DOUBLE)) - floor(u + step * k::DOUBLE), {MOST}) AS c FROM o
), g AS (
  SELECT source, sum(c * size) AS taken, sum(size) AS drawn FROM f WHERE k < large GROUP BY source
), w AS (
  SELECT f.*, CASE WHEN f.source_size > coalesce(g.drawn, 0) THEN greatest(0, least({float(MOST)}::DOUBLE, (f.target - coalesce(g.taken, 0)) / (f.source_size - coalesce(g.drawn, 0)))) ELSE step END AS others
  FROM f LEFT JOIN g ON f.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN k < large THEN c ELSE least(floor(u + step * large::DOUBLE + others * (k - large + 1.0::DOUBLE)) - floor(u + step * large::DOUBLE + others * (k - large)::DOUBLE), {MOST}) END) * size)::BIGINT AS taken
FROM w
"""
