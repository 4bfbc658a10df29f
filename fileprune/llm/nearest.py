"""Nearest neighbours by a block matrix join.

Candidates are dealt to slabs and queries to blocks; a slab and a block meet in one task, which holds the slab, of a bounded
size, and lets the block's queries pass by some at a time. Candidates are sent once to each block of 65,536 queries,
queries once to each slab. Tiles of int8 products give every cosine with a bound on the error of quantising: with unit vectors
x = sx * qx + ex and y = sy * qy + ey, the product differs from sx * sy * (qx . qy) by at most
|ex| + |ey| + |ex| * |ey|. Pairs whose upper bound reaches the k-th best lower bound survive; only these are computed in
double precision, and heaps keep the k best of a query over the tiles of a slab. Then the slabs' heaps are merged.
No pair that belongs to the result is lost: the search is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm.common import batch_rows, written
from fileprune.llm.words import only_here

#: Queries of a block; numbers (rows times dimension) of a slab; queries and rows of a tile.
QUERY_BLOCK, SLAB_NUMBERS, TILE_QUERIES, TILE = 1 << 16, 1 << 22, 256, 4_096
#: Sums of so many products of int8 values are whole numbers below 2 ** 24, so exact in single precision.
EXACT_SUM = 1_024
#: What the rounding of scales, lengths and products in double precision may add, for each dimension.
SLACK = 1e-12


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the errors of unit vectors."""
    scale = np.abs(unit).max(axis=1, initial=0.0) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed in the order of the components."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


class Side:
    """Vectors of one side of a tile, and the same of unit length, quantised.

    ``vectors`` are the given ones times a power of two that brings their largest component between a half and one: no square
    overflows or vanishes, and cosines keep every bit.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = np.asarray(vectors, np.float64)
        _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
        self.ids, self.vectors = ids, np.ldexp(vectors, -exponent[:, None])
        length = np.linalg.norm(self.vectors, axis=1, keepdims=True)
        codes, self.scale, self.error = quantised(self.vectors / length)
        self.codes = codes.astype(np.float32)

    def part(self, begin: int, end: int) -> Side:
        out = object.__new__(Side)
        out.ids, out.vectors, out.codes, out.scale, out.error = (x[begin:end] for x in (self.ids, self.vectors, self.codes, self.scale, self.error))
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sums of products of int8 values, EXACT_SUM components at a time."""
    out = (a[:, :EXACT_SUM] @ b[:, :EXACT_SUM].T).astype(np.float64)
    for i in range(EXACT_SUM, a.shape[1], EXACT_SUM):
        out += a[:, i : i + EXACT_SUM] @ b[:, i : i + EXACT_SUM].T
    return out


def tile_best(queries: Side, rows: Side, k: int, heaps: list[list[tuple[float, int]]]) -> int:
    """Put what a tile adds to the k best of each query into ``heaps`` of (score, -id); returns the number of survivors."""
    near = products(queries.codes, rows.codes)
    near *= queries.scale[:, None] * rows.scale[None, :]
    bound = queries.error[:, None] + rows.error[None, :] + queries.error[:, None] * rows.error[None, :] + SLACK * (queries.codes.shape[1] + 16)
    low, high = near - bound, near + bound
    own = queries.ids[:, None] == rows.ids[None, :]
    low[own] = high[own] = -np.inf
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    alive = (high >= np.maximum(floor, held)[:, None]) & ~own
    q, r = np.nonzero(alive)
    scores = cosines(queries.vectors[q], rows.vectors[r])
    for i, score, vec in zip(q.tolist(), scores.tolist(), rows.ids[r].tolist()):
        heap = heaps[i]
        if len(heap) < k:
            heapq.heappush(heap, (score, -vec))
        elif (score, -vec) > heap[0]:
            heapq.heapreplace(heap, (score, -vec))
    return len(q)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) as doubles of the rows that take part: an id, and a vector without nulls or non-finite values that isn't zero."""
    value = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).where(F.size("embedding") > 0).where(finite).where(F.exists("embedding", lambda x: x != 0))


def search(rows: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its k nearest of all other rows.

    Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite values take no part; vectors
    of different lengths are never compared, and no magnitude is too large or too small. Rows that repeat a query's own vec_id aren't its neighbours; of rows with
    equal score the smaller vec_id is nearer; a repeated (vec_id, vector) counts once. An empty table gives no rows.
    """
    good = written(usable(rows).dropDuplicates(), "vectors")
    dim, n = F.size("embedding"), good.count()
    hashed = F.xxhash64(F.lit("block"), "vec_id", "embedding")
    slabs = F.greatest(F.ceil(F.lit(float(n)) * dim / F.lit(float(SLAB_NUMBERS))), F.lit(1)).cast("int")
    asks = good.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    queries = asks.select(dim.alias("dim"), F.explode(F.sequence(F.lit(0), slabs - 1)).alias("slab"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "vec_id", "embedding")
    candidates = good.select(dim.alias("dim"), F.pmod(F.shiftright(hashed, 20), slabs).cast("int").alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "vec_id", "embedding")
    keys = ["dim", "slab", "block"]
    met = candidates.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "side")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("nearest", lambda: None)
        now, held, slab = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            ids, lists = batch.column(4).to_numpy(), batch.column(5)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else []
            for begin, end in zip(cuts, cuts[1:]):
                *key, side = names[begin]
                vectors = values[offsets[begin] : offsets[end]].reshape(end - begin, key[0])
                if key != now:
                    now, held, slab = key, [], None
                if not side:
                    held.append((ids[begin:end], vectors))
                    continue
                if slab is None and held:
                    slab, held = Side(*map(np.concatenate, zip(*held))), []
                if slab is None:
                    continue
                out: list[tuple[int, int, float]] = []
                for q in range(0, end - begin, TILE_QUERIES):
                    asked = Side(ids[begin:end][q : q + TILE_QUERIES], vectors[q : q + TILE_QUERIES])
                    heaps: list[list[tuple[float, int]]] = [[] for _ in asked.ids]
                    for r in range(0, len(slab.ids), TILE):
                        tile_best(asked, slab.part(r, r + TILE), k, heaps)
                    out += [(int(i), -vec, score) for i, heap in zip(asked.ids, heaps) for score, vec in heap]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    with batch_rows(rows.sparkSession, 4_096):
        found = written(met.mapInArrow(best, "query_id long, vec_id long, score double"), "nearest")

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The partition's heaps of each query; it holds every row of its queries."""
        heaps: dict[int, list[tuple[float, int]]] = {}
        for part in parts:
            for query, vec, score in zip(part.query_id.tolist(), part.vec_id.tolist(), part.score.tolist()):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        rows = [(q, i + 1, -vec, score) for q, heap in heaps.items() for i, (score, vec) in enumerate(sorted(heap, reverse=True))]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    return found.dropDuplicates(["query_id", "vec_id", "score"]).repartition("query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


#: The same for DuckDB, of all pairs.
ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
