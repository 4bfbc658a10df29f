"""SimHash near-duplicates by pigeonhole blocks.

``fingerprint_components``: 64-bit fingerprints that differ in at most ``distance`` bits are linked. The bits are split
into blocks; a pair that close agrees in all but ``distance`` of them, so for some choice of the other blocks it has
equal keys. Pairs are joined on those keys and their Hamming distance is verified.

``near_links``: pairs of shingle sets with a Jaccard similarity of at least ``similarity``. There a fingerprint is
wide: it is made of blocks, each the SimHash of one class of the shingles (by their hash), with as many classes as half
the shingles, a power of two. Of the classes the first BLOCKS are kept, of which one has members and no difference but for
a chance below 1 in 100,000 (a class has 2 to 4 shingles). Pairs that share a block are compared by the Hamming distance
of 512-bit fingerprints, and those near enough by their shingles. Few classes may all differ or be empty, so sets
below SMALL shingles are found by a prefix filter, which is exact: in the order of the hashes, sets that similar share one
of the first ``size - ceil(similarity * size) + 1``. Such pairs are compared by the parities of their shingles over 256
buckets, which differ in no more buckets than the sets do in shingles, and then by their shingles.

Equal texts are one row from the start. Each row is first held against one other row of its blocks, the first that is
near, which connects a family of near copies in one pass however large it is. What a block then still has in different
components is compared in tiles of a bounded number of rows: rows of one component are never compared again, so a block whose
rows are connected costs nothing more. Blocks that very many texts share, for a passage that all of them have, would still cost the
square of their rows. Their rows are found by a prefix filter instead, in the order of how rare a shingle is among them:
what everybody has comes last and is no key. It is exact, so no pair within the Hamming limit is left out either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileprune.llm.bpe import slices
from fileprune.llm.common import Scratch, batch_rows, unused, written
from fileprune.llm.graph import components
from fileprune.llm.words import only_here

#: Fixed value: the seed of the shingles' hash.
HASH_SEED = 42
BITS = 64
#: Rows, and shingles, of one side of a tile.
TILE, TILE_SHINGLES = 512, 1 << 19
#: Blocks of the narrow fingerprints: with 6 blocks and 3 bits, 20 keys of 32 bits or so each.
NARROW_BLOCKS = 6
#: Most blocks of a wide fingerprint; words of 64 bits of the fingerprints that pairs are compared by; and the Hamming distance up
#: to which a pair's shingles are. At a similarity of 0.8 a bit differs with a chance of arccos(8 / 9) / pi = 0.151, so of 512 bits
#: more than 128 do in fewer than 1 of 10 million pairs; below a similarity of 0.4 next to no pair is that close.
BLOCKS, WIDE_WORDS, WIDE_DISTANCE = 24, 8, 128
#: Sets with fewer shingles, and those that are similar to one, are found by prefixes.
SMALL, PARITY_WORDS = 64, 4
WIDE, PARITY = [f"w{i}" for i in range(WIDE_WORDS)], [f"o{i}" for i in range(PARITY_WORDS)]
#: Rows that one copy of the row they are held against is sent to.
FAN = 512
#: Blocks with more rows than this, in different components, aren't compared in tiles: their rows meet by their rarest shingles.
HOT = 16 * TILE


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words (of all words if there are fewer), A-Z in lower case; empty without words."""
    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= words:
        return np.array([digest(joined, HASH_SEED)], np.uint64)
    starts, at = [], 0
    for word in split:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    return np.array([digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, starts[words:])], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of each row, lowest first: of one hash, or of several in a row."""
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Whether a bit is set in over half of the rows, as 64-bit numbers; 255 rows at a time are added up as bytes."""
    bits = BITS * hashes[:1].size
    total = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = _bits(hashes[i : i + 255 * 64])
        whole = len(part) // 255
        total += np.add.reduce(part[: whole * 255].reshape(whole, 255, bits), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(part[whole * 255 :], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without hashes."""
    return int(_majority(hashes)[0]) if len(hashes) else 0


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                fps = _signed([fingerprint(shingle_hashes(t, words)) for t in texts])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(begin, len(texts)), "fp": pa.array(fps, pa.int64())})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - distance`` blocks of the 64 bits."""
    if not distance < blocks <= BITS:
        raise ValueError("there must be more blocks than bits that may differ")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(single, blocks - distance)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the graph of pairs that are near."""
    left, edges = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            node = queue.pop()
            found = np.flatnonzero(near[node] & left)
            left[found] = False
            edges += [(node, x) for x in found.tolist()]
            queue += found.tolist()
    return edges


def dealt(members: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(key, a, b, side, id, root, columns): the tiles of ``members`` (key, id, root, ``columns``), keys with a single root left out.

    The rows of a key are dealt to slots of about TILE rows (and a sum of ``weight`` of TILE_SHINGLES) by a hash, a
    root that fills slots alone to its own, and each pair of slots is a tile. Two slots of one such root make no tile, so that
    the tiles of a key whose rows belong to one large root and a few others grow with its rows, not with their square.
    side is 0 in slot a and 1 in slot b; a tile of one slot (a = b) has all its pairs, others the pairs between the sides.
    """
    share = F.count(F.lit(1)) / F.lit(float(TILE))
    share = share if weight is None else F.greatest(share, F.sum(weight) / F.lit(float(TILE_SHINGLES)))
    groups = members.groupBy("key", "root").agg(share.alias("_share"))
    rest = F.ceil(F.sum(F.when(F.col("_share") < 1, F.col("_share")))).cast("int")
    large = F.sum(F.when(F.col("_share") >= 1, F.ceil("_share"))).cast("int")
    keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("_roots"), F.coalesce(rest, F.lit(0)).alias("_rest"), F.coalesce(large, F.lit(0)).alias("_large")).where("_roots > 1")
    # of a key no more than its rows over TILE
    own = groups.where("_share >= 1").select("key", "root", F.ceil("_share").cast("int").alias("_n"))
    own = own.withColumn("_first", (F.sum("_n").over(Window.partitionBy("key").orderBy("root")) - F.col("_n")).cast("int"))
    placed = members.join(keys.drop("_roots"), "key").join(own, ["key", "root"], "left")
    begin = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.col("_rest") + F.col("_first"))
    slot = begin + F.pmod(F.xxhash64(F.lit("slot"), "id"), F.coalesce("_n", "_rest")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_rest") + F.col("_large") - 1), lambda x: F.col("_n").isNull() | (x < F.col("_begin")) | (x >= F.col("_begin") + F.col("_n")))
    met = placed.withColumn("_begin", begin).withColumn("_slot", slot).withColumn("_other", F.explode(others))
    return met.select("key", F.least("_slot", "_other").alias("a"), F.greatest("_slot", "_other").alias("b"), (F.col("_slot") > F.col("_other")).cast("int").alias("side"), "id", "root", *columns)


def in_tiles(tiled: DataFrame, edges_of: Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v): for each tile of ``tiled`` the ids at the two places that ``edges_of`` (rows, number of rows of side 0 or 0 if all pairs count) gives."""
    ready = tiled.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("simhash", lambda: None)
        kept = None

        def links(rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            ids, sides, cross = (rows[c].to_numpy() for c in ("id", "side", "b"))
            cross = cross != rows["a"].to_numpy()
            us, vs, found = [], [], 0
            for begin, end in zip(bounds, bounds[1:]):
                first = int((sides[begin:end] == 0).sum()) if cross[begin] else 0
                if end - begin > max(1, first) and (first or not cross[begin]):
                    i, j = edges_of(rows.slice(begin, end - begin), first)
                    us.append(ids[begin + i])
                    vs.append(ids[begin + j])
                    found += len(i)
                if found > 1 << 16:
                    yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})
                    us, vs, found = [], [], 0
            if found:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
            key, a, b = (rows[c].to_numpy() for c in ("key", "a", "b"))
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
            if cuts:
                yield from links(rows.slice(0, cuts[-1]), [0, *cuts])
                kept = rows.slice(cuts[-1])
            else:
                kept = rows
        if kept is not None and kept.num_rows:
            yield from links(kept, [0, kept.num_rows])

    return ready.mapInArrow(run, "u long, v long")


def _between(near: np.ndarray, first: int) -> np.ndarray:
    """Only the pairs between the first rows and the rest, if ``first`` isn't 0."""
    if first:
        near[:first, :first] = near[first:, first:] = False
    return near


def _fingerprint_edges(distance: int) -> Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray]]:
    def edges(rows: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
        far = _distances(rows["id"].to_numpy().view(np.uint64))
        found = np.array(spanning(_between(far <= distance, first)), int).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    return edges


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _shared(keyed: DataFrame, distance: int) -> DataFrame:
    """(u, v) of fingerprints of ``keyed`` (key, id) that share a key and are close: keys of two rows at once, the rest by tiles."""
    counted = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("u"), F.max("id").alias("v")).where("n > 1"), "keys")
    pairs = counted.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    members = keyed.join(counted.where("n > 2").select("key"), "key").withColumn("root", F.col("id"))
    return _ordered(pairs.union(in_tiles(dealt(members, []), _fingerprint_edges(distance))))


def _distances(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ fps[None, :])


def fingerprint_components(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = NARROW_BLOCKS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. component_id is
    the least doc_id that links lead to, the row's own included; null if no row of the component has a doc_id. Repeated
    rows stay; other columns are ignored; an empty table gives an empty one.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    masks = block_masks(distance, blocks)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_as_long(m)))) for i, m in enumerate(masks)))
    roots = components(_shared(distinct.select(F.explode(keys).alias("key"), F.col("fp").alias("id")), distance))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the hashes (the last steps of SplitMix64)."""
    with np.errstate(over="ignore"):
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def prefix_keys(hashes: np.ndarray, similarity: float) -> list[int]:
    """The least of the sorted distinct hashes, as many as it takes to share one with every set that similar; none for sets that wide blocks find."""
    size = len(hashes)
    if not size:
        return [0]
    return hashes[: size - math.ceil(similarity * size - 1e-9) + 1].tolist() if size * similarity < SMALL else []


def parities(hashes: np.ndarray) -> np.ndarray:
    """64 * PARITY_WORDS bits, as numbers: whether the number of hashes in each of as many buckets is odd."""
    buckets = BITS * PARITY_WORDS
    odd = np.bincount((_mixed(hashes) % np.uint64(buckets)).astype(int), minlength=buckets) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def wide_print(hashes: np.ndarray) -> list[int]:
    """WIDE_WORDS fingerprints by as many hashes of the hashes."""
    columns = [hashes]
    for _ in range(WIDE_WORDS - 1):
        columns.append(_mixed(columns[-1]))
    return _majority(np.stack(columns, axis=1)).tolist()


def wide_blocks(hashes: np.ndarray, similarity: float) -> list[int]:
    """Keys of the blocks of a wide fingerprint of distinct hashes, for sets of this size and of those up to 1 / similarity as large; none for small sets."""
    size = len(hashes)
    if size < SMALL:
        return []
    levels = {size.bit_length() - 1, int(size / similarity + 1e-9).bit_length() - 1}
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    keys = []
    for level in levels:
        width = max(0, level - 1)
        classes = mixed >> np.uint64(64 - width) if width else np.zeros(size, np.uint64)
        first = classes < BLOCKS
        order = np.argsort(classes[first], kind="stable")
        chosen, members = classes[first][order], hashes[first][order]
        if not len(chosen):
            continue
        begins = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        counts = np.diff(np.append(begins, len(chosen)))
        ones = np.add.reduceat(_bits(members), begins, axis=0, dtype=np.int32)
        prints = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
        keys += [xxhash.xxh64_intdigest(int(p).to_bytes(8, "little"), level << 32 | int(c)) for p, c in zip(prints, chosen[begins])]
    return keys


def jaccard(a: str, b: str, words: int) -> float:
    """Similarity of the texts' shingle sets; 1 if both have no words."""
    return set_similarity(np.unique(shingle_hashes(a, words)), np.unique(shingle_hashes(b, words)))


def set_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def _differing(similarity: float) -> float:
    """Most shingles that are in one of two sets that similar only, over the sum of the sizes."""
    return (1 - similarity) / (1 + similarity)


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def is_small(size: np.ndarray | Column, similarity: float):
    """Whether sets of that size have parities and prefixes; those from SMALL on have a wide fingerprint."""
    return size * similarity < SMALL


def tile_near(rows: pa.Table, first: int, similarity: float) -> np.ndarray:
    """Which pairs of a tile's rows have different roots and can be that similar by size and fingerprint."""
    sizes, roots = rows["size"].to_numpy().astype(np.int64), rows["root"].to_numpy()
    wide, odd = (np.stack([rows[c].to_numpy() for c in names]).view(np.uint64) for names in (WIDE, PARITY))
    small, n = is_small(sizes, similarity), len(sizes)
    near = np.zeros((n, n), bool)
    for i in range(0, first or n, 128):
        part, rest = slice(i, min(i + 128, first or n)), slice(first, n)
        far = sum(np.bitwise_count(w[part, None] ^ w[rest]).astype(np.uint16) for w in wide)
        close = far <= WIDE_DISTANCE
        both = small[part, None] & small[rest]
        if both.any():
            apart = sum(np.bitwise_count(w[part, None] ^ w[rest]).astype(np.uint16) for w in odd)
            close = np.where(both, apart <= (sizes[part, None] + sizes[rest]) * _differing(similarity) + 1e-9, close)
        close &= roots[part, None] != roots[rest]
        close &= np.minimum(sizes[part, None], sizes[rest]) >= similarity * np.maximum(sizes[part, None], sizes[rest]) - 1e-9
        near[part, rest] = close
    return near | near.T if first else near


def similar_pairs(sets: list[np.ndarray], near: np.ndarray, similarity: float) -> np.ndarray:
    """``near`` without the pairs of sets that aren't that similar: pair by pair, or all shared shingles as one product."""
    out = np.zeros_like(near)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return out
    i, j = np.nonzero(np.triu(near))
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes[rows])
    by_pair = len(i) * 20e-6 + float((sizes[i] + sizes[j]).sum()) * 20e-9
    both = None
    if by_pair > len(values) * 150e-9:
        word, at, count = np.unique(values, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        shared = count[at] > 1
        owner, at = owner[shared], column[at[shared]]
        width = int((count > 1).sum())
        if by_pair > len(rows) ** 2 * width * 5e-11:
            order = np.argsort(at, kind="stable")
            owner, at = owner[order], at[order]
            both = np.zeros((len(rows), len(rows)), np.float32)
            for begin in range(0, width, 2048):
                a, b = np.searchsorted(at, (begin, begin + 2048))
                part = np.zeros((len(rows), min(2048, width - begin)), np.float32)
                part[owner[a:b], at[a:b] - begin] = 1
                both += part @ part.T
            place = np.full(len(sets), -1)
            place[rows] = np.arange(len(rows))
            common = both[place[i], place[j]].astype(np.float64)
    if both is None:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], float)
    every = sizes[i] + sizes[j] - common
    good = common >= similarity * every - 1e-9
    out[i[good], j[good]] = out[j[good], i[good]] = True
    return out


def _sets(rows: pa.Table) -> list[np.ndarray]:
    lists = rows["hashes"].combine_chunks()
    values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(spanning(pairs), int).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def sketched(docs: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, node, doc_id, size, wide words, parity words, keys) of each different text: node is its MD5, doc_id that of one of its rows."""
    prints = [*WIDE, *PARITY]
    out = "node string, doc_id long, size int, keys array<long>, " + ", ".join(f"{c} long" for c in prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("simhash", lambda: None)
        for batch in batches:
            for begin, texts in slices(batch.column(2)):
                sets = [np.unique(shingle_hashes(t, words)) for t in texts]
                wide = [wide_print(s) if len(s) >= SMALL else [0] * WIDE_WORDS for s in sets]
                odd = [parities(s).tolist() if is_small(len(s), similarity) else [0] * PARITY_WORDS for s in sets]
                columns = np.array([a + b for a, b in zip(wide, odd)], np.uint64).reshape(len(sets), len(prints))
                fixed = {"node": batch.column(0).slice(begin, len(texts)), "doc_id": batch.column(1).slice(begin, len(texts)), "size": pa.array([len(s) for s in sets], pa.int32())}
                fixed["keys"] = pa.array([_signed(wide_blocks(s, similarity) + prefix_keys(s, similarity)) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(fixed | {c: pa.array(_signed(columns[:, k].copy()), pa.int64()) for k, c in enumerate(prints)})

    with batch_rows(docs.sparkSession, 500):
        rows = _named(docs).mapInArrow(run, out).dropDuplicates(["node"])
        return scratch.written(rows.withColumn("id", F.monotonically_increasing_id()), "sketches")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_text_key(F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def shingle_sets(docs: DataFrame, ids: DataFrame, sketches: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(id, hashes): the sorted shingle hashes of ``ids`` (id), each once. Of a text's copies one row is read: copies never meet."""
    chosen = ids.join(sketches.select("id", "node", F.col("doc_id").alias("_doc")), "id")
    rows = _named(docs).alias("d").join(chosen.alias("c"), (F.col("d.node") == F.col("c.node")) & F.col("d.doc_id").eqNullSafe(F.col("c._doc"))).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("simhash", lambda: None)
        seen: set[int] = set()  # rows equal in text and doc_id are in one partition
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in slices(batch.column(1)):
                new = {i: np.unique(shingle_hashes(t, words)) for i, t in zip(ids[begin : begin + len(texts)], texts) if i not in seen}
                seen |= new.keys()
                yield pa.RecordBatch.from_pydict({"id": pa.array(new.keys(), pa.int64()), "hashes": pa.array([_signed(x) for x in new.values()], pa.list_(pa.int64()))})

    with batch_rows(docs.sparkSession, 500):
        return scratch.written(rows.mapInArrow(run, "id long, hashes array<long>"), "shingles")


def _held_against(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (id, pivot) whose sets are that similar, as (u, v). A pivot's set is sent once to each FAN of its rows."""
    fans = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("n"))
    rows = pairs.join(fans, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("fan"), F.lit(1).alias("side"), "id")
    heads = fans.select("pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fan"), F.lit(0).alias("side"), F.col("pivot").alias("id"))
    ready = rows.unionByName(heads).join(sets, "id").select("pivot", "fan", "side", "id", "hashes").repartition("pivot", "fan").sortWithinPartitions("pivot", "fan", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("simhash", lambda: None)
        pivot, against = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            sets_ = _sets(pa.Table.from_batches([batch]))
            for head, side, name, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets_):
                if not side:
                    pivot, against = head, own.copy()
                elif pivot == head and set_similarity(own, against) >= similarity:
                    us.append(name)
                    vs.append(head)
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    with batch_rows(pairs.sparkSession, 500):
        return scratch.written(ready.mapInArrow(run, "u long, v long"), "links")


def rare_shingles(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, key): the rarest shingles of each of ``sets`` (id, hashes), as many as it takes to share one with every set that similar; those of one set only are left out."""
    each = sets.select("id", F.explode("hashes").alias("key"))
    often = scratch.written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingle-counts")
    shared = each.join(often, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))  # a text's own
    size = F.size("hashes")
    prefix = size - F.ceil(size * F.lit(similarity) - 1e-9) + 1
    alone = prefix - (size - F.size("found"))  # shingles of one set come first and take their part of the prefix
    rows = sets.join(shared, "id").where(alone > 0)
    return scratch.written(rows.select("id", F.explode(F.slice("found", F.lit(1), alone.cast("int"))).alias("x")).select("id", F.col("x.key").alias("key")), "rare-shingles")


def near_links(docs: DataFrame, sketches: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(u, v): ids of ``sketches`` whose shingle sets have at least that similarity; enough of them to connect what is similar."""
    prints = [*WIDE, *PARITY]
    keyed = sketches.select(F.explode("keys").alias("key"), "id")
    counted = scratch.written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1"), "keys")
    members = keyed.join(counted, "key")

    facts = sketches.select("id", "size", *prints)
    other = sketches.select(F.col("id").alias("pivot"), F.col("size").alias("_size"), *(F.col(c).alias(f"_{c}") for c in prints))
    far, odd = (reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in names)) for names in (WIDE, PARITY))
    sum_, small = F.col("size") + F.col("_size"), F.greatest("size", "_size")
    close = F.when(is_small(small, similarity), odd <= sum_ * F.lit(_differing(similarity)) + 1e-9).otherwise(far <= WIDE_DISTANCE)
    close &= F.least("size", "_size") >= F.greatest("size", "_size") * F.lit(similarity) - 1e-9
    near = scratch.written(members.where("id <> pivot").select("id", "pivot").distinct().join(facts, "id").join(other, "pivot").where(close).select("id", "pivot"), "near")
    pairs = scratch.written(near.groupBy("id").agg(F.min("pivot").alias("pivot")), "pairs")
    asked = pairs.select("id").union(pairs.select("pivot")).distinct()
    links = _held_against(pairs, shingle_sets(docs, asked, sketches, words, scratch), similarity, scratch)

    roots = components(links, scratch)
    named = roots.select(F.col("node").alias("id"), "root")
    rooted = members.where("n > 2").select("key", "id", "n").join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = scratch.written(rooted, "rooted")
    met = rooted.where(F.col("n") <= HOT).drop("n")
    hot = rooted.where(F.col("n") > HOT)
    if not hot.isEmpty():
        split = hot.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        hot = scratch.written(hot.join(split, "key").select("id", "root").distinct(), "hot")
        rare = rare_shingles(shingle_sets(docs, hot.select("id"), sketches, words, scratch), similarity, scratch)
        met = met.unionByName(rare.join(hot, "id"))
    tiled = dealt(met, []).join(facts, "id")
    # of a key of two rows the pair was seen above
    unlinked = near.join(named, "id", "left").join(named.select(F.col("id").alias("pivot"), F.col("root").alias("_root")), "pivot", "left")
    unlinked = unlinked.where(F.coalesce("root", "id") != F.coalesce("_root", "pivot")).select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    apart = scratch.written(unlinked.union(in_tiles(tiled, lambda rows, first: _forest(tile_near(rows, first, similarity)))).distinct(), "apart")
    if apart.isEmpty():
        return links
    # what is near but in different components meets once more, with the shingles
    groups = components(apart, scratch)
    found = scratch.written(groups.select("node", "root").union(groups.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").alias("id"), F.col("root").alias("key")), "apart-ids")
    sets = shingle_sets(docs, found.select("id"), sketches, words, scratch)
    together = found.join(named, "id", "left").withColumn("root", F.coalesce("root", "id")).join(facts, "id")
    tiled = dealt(together, ["size", *prints], "size").join(sets, "id")
    with batch_rows(docs.sparkSession, 500):
        more = scratch.written(in_tiles(tiled, lambda rows, first: _forest(similar_pairs(_sets(rows), tile_near(rows, first, similarity), similarity))), "more-links")
    return links.union(more)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component, least, n): for each different text (by MD5) its component and, of that component, the row to keep.

    least is the struct (no id, doc_id, node) that is smallest in the component: rows with a doc_id come first. n counts
    the component's rows that are equal to it in doc_id and text.
    """
    rows = docs.select(_text_key(F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("node"))
    nodes = rows.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct(row.alias("row"), F.col("n"))).alias("first"))
    with Scratch(docs.sparkSession, "near-duplicates") as scratch:
        sketches = sketched(docs, words, similarity, scratch)
        roots = components(near_links(docs, sketches, words, similarity, scratch), scratch)
        ids = sketches.select("id", "node").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("node", F.coalesce("root", "id").alias("component"))
        named = scratch.written(nodes.join(ids, "node").select("node", "component", "first"), "components")
        # written, so that the rows of a large component can be dealt to several tasks
        kept = scratch.written(named.groupBy("component").agg(F.min("first").alias("kept")), "kept")
        return written(named.join(kept, "component").select("node", "component", F.col("kept.row").alias("least"), F.col("kept.n").alias("n")), "near-duplicates")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least doc_id (nulls last, then by text).

    Texts without words are copies of each other. Of rows equal in doc_id and text one stays.
    Columns are kept whatever their names.
    """
    columns = docs.columns
    node, key = unused(docs, "_node"), unused(docs, "_id_key")
    groups = near_duplicates(docs, words, similarity)
    stays = groups.where("node = least.node").select(F.col("node").alias(node), F.coalesce(F.col("least.doc_id").cast("string"), F.lit("null")).alias(key), F.col("n").alias(many := unused(docs, "_many")))
    marked = docs.withColumn(node, _text_key(F.col("text"))).withColumn(key, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))
    found = marked.join(stays, [node, key])
    out = found.where(F.col(many) == 1)
    if not stays.where(F.col(many) > 1).isEmpty():
        out = out.unionByName(found.where(F.col(many) > 1).dropDuplicates([node, key]))
    return out.select(*(F.col(f"`{c}`") for c in columns))
