"""Bloom filters as rows of blocks, built and probed with built-in functions only.

A file with n distinct values has a filter of m bits, a power of two, in blocks of BLOCK bits. A value belongs to one block
and sets k bits of it, all by hashes of the value as text. A row holds one block of a file's filter, so a probe joins each
value with one row of each file and tests its bits there: neither filters nor values come to the driver, and nothing has
to be put together again afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block. At 1 % false positives some 430 values share one, so blocks fill up evenly enough.
BLOCK = 4096


def _bits(count: Column, fpr: float) -> Column:
    wanted = F.greatest(count, F.lit(1)) * F.lit(-math.log(fpr) / math.log(2) ** 2)
    return F.greatest(F.lit(BLOCK), F.pow(F.lit(2), F.ceil(F.log2(wanted)))).cast("long")


def hashes(fpr: float) -> int:
    return max(1, round(-math.log2(fpr)))


def _block(value: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), F.expr(f"m div {BLOCK}")).alias("block")


def _positions(value: Column, k: int) -> Column:
    return F.array_distinct(F.array(*(F.pmod(F.xxhash64(value, F.lit(i)), F.lit(BLOCK)).cast("int") for i in range(k))))


def build(values: DataFrame, fpr: float) -> DataFrame:
    """(filename, m, block, words) of distinct (filename, value); null values have no part. words has the block's bits, 64 in a number."""
    texts = values.where("value is not null").select("filename", F.col("value").cast("string").alias("value"))
    sizes = texts.groupBy("filename").agg(_bits(F.count(F.lit(1)), fpr).alias("m"))
    at = texts.join(sizes, "filename").select("filename", "m", _block(F.col("value"), F.col("m")), F.explode(_positions(F.col("value"), hashes(fpr))).alias("p"))
    word = at.select("filename", "m", "block", F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bit"))
    words = word.groupBy("filename", "m", "block", "word").agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("filename", "m", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # 64 words at most
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.try_element_at("held", i.cast("long")), F.lit(0).cast("long")))
    return held.select("filename", "m", "block", every.alias("words"))


def probe(filters: DataFrame, values: DataFrame, fpr: float) -> DataFrame:
    """Distinct filenames whose filter may hold one of ``values`` (column value, of the indexed type)."""
    texts = values.where("value is not null").select(F.col("value").cast("string").alias("value")).distinct()
    widths = [r["m"] for r in filters.select("m").distinct().collect()]  # powers of two: a few dozen at most
    if not widths:
        return filters.select("filename")
    asked = texts.withColumn("m", F.explode(F.array(*(F.lit(m).cast("long") for m in widths))))
    asked = asked.select("m", _block(F.col("value"), F.col("m")), _positions(F.col("value"), hashes(fpr)).alias("positions"))
    one = F.lit(1).cast("long")
    held = F.forall("positions", lambda p: F.call_function("shiftright", F.element_at("words", F.floor(p / F.lit(64)).cast("int") + 1), p % 64).bitwiseAND(one) == 1)
    return filters.join(asked, ["m", "block"]).where(held).select("filename").distinct()
