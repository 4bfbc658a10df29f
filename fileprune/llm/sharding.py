"""Sharding by a Feistel permutation over global row numbers.

The row numbers 0..n-1 (documents by doc_id) are permuted by a balanced Feistel network on the smallest even number of
bits that holds n; a value outside 0..n-1 is sent through the network again until it falls inside (cycle walking), which
keeps the map a bijection of 0..n-1. Position p goes to shard p mod s, slot p div s: counts differ by one at most, slots
have no gaps, and both directions can be computed without a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm.common import global_rank, text_crc32, unused, written

ROUNDS = 6
#: What each document takes in a shard besides its bytes.
ROW_OVERHEAD = 16


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts, as the network's round function."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class FeistelPermutation:
    """A seeded bijection of 0..size-1 with its inverse. size 0 and 1 are the identity."""

    size: int
    seed: int = 0

    @property
    def _half(self) -> int:
        return max(1, ((max(self.size, 2) - 1).bit_length() + 1) // 2)

    def _keys(self) -> list[int]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return [int(k) for k in rng.integers(0, 1 << 63, ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self._half), np.uint64((1 << self._half) - 1)
        left, right = x >> half, x & mask
        if back:
            for key in reversed(self._keys()):
                left, right = right ^ (_mixed(left, key) & mask), left
        else:
            for key in self._keys():
                left, right = right, left ^ (_mixed(right, key) & mask)
        return (left << half) | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(values, dtype=np.uint64).copy()
        if self.size < 2 or not len(out):
            return out.astype(np.int64)
        if int(out.max()) >= self.size:
            raise ValueError("a row number lies outside the permutation")
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], back)
            todo = todo[out[todo] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def forward(self, values) -> np.ndarray:
        return self._walk(values, back=False)

    def inverse(self, values) -> np.ndarray:
        return self._walk(values, back=True)

    def place(self, row: int, shards: int) -> tuple[int, int]:
        """Shard and slot of one row number."""
        at = int(self.forward([row])[0])
        return at % shards, at // shards

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number stored at (shard, slot)."""
        return int(self.inverse([slot * shards + shard])[0])


def shard_rows(df: DataFrame, order: list, shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with shard and slot; ``order`` gives the global row numbers.

    Rows equal in all of ``order`` are interchangeable. An empty table stays empty. A column of df that is called like
    an output column is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rank = unused(df, "_rank")
    ranked = global_rank(df, order, "sharding", rank)
    permutation = FeistelPermutation(ranked.count(), seed)

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(rows.to_numpy()))

    at = unused(df, "_at")
    placed = ranked.withColumn(at, position(F.col(rank)))
    return placed.withColumn(shard, (F.col(at) % shards).cast("int")).withColumn(slot, F.floor(F.col(at) / F.lit(shards)).cast("long")).drop(rank, at)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all ``docs``, by the law ``rows``.

    Only doc_id, size and checksum are moved, never the text. A null text counts 0 bytes and has checksum 0; null
    doc_ids come first and repeated rows each get a slot. Other columns are ignored.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
    )
    narrow = written(narrow, "sharding-rows")  # the texts are read once
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    placed = shard_rows(narrow, order, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
