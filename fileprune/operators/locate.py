"""Which files can hold some values: tables of filenames, joined by AND over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fileprune.conf import setting
from fileprune.errors import ColumnNotFoundException
from fileprune.functions import bloom
from fileprune.operators.build import IndexTables
from fileprune.plans.metadata import IndexMetadata

#: Up to so many different values a range is held against each; beyond, against their least and greatest.
RANGE_VALUES = 1000
#: From so many indexed bytes on, a location tries one value in FIRST_SHARE first (FIRST_VALUES at most): if those are in all files, the others add none.
LARGE_BYTES, FIRST_SHARE, FIRST_VALUES = 128 << 20, 256, 50_000


def value_type(spark: SparkSession, meta: IndexMetadata, tables: IndexTables, column: str) -> T.DataType:
    """The indexed type of a column."""
    kind, schema = meta.kinds()[column], meta.struct()
    if kind in ("regular", "bloom", "temporal", "range"):
        return schema[column].dataType
    found = tables.of(kind, column).schema()
    if found is not None:
        return found["value"].dataType
    empty = spark.createDataFrame([], schema)
    if kind == "computed":
        return empty.select(F.expr(meta.computed[column])).schema[0].dataType
    x = next(x for x in meta.exploded if x["as_column"] == column)
    return empty.select(F.explode(F.col(f"{x['array_column']}.{x['field_path']}"))).schema[0].dataType


def typed(column: Column, kind: T.DataType) -> Column:
    """The value as the index has it; what can't be cast matches nothing."""
    return column.try_cast(kind)


def literal_values(spark: SparkSession, values: list, kind: T.DataType) -> DataFrame:
    rows = [(v,) for v in values if v is not None]
    if not rows:
        return spark.createDataFrame([], T.StructType([T.StructField("value", kind)]))
    try:
        raw = spark.createDataFrame(rows, T.StructType([T.StructField("value", kind)]))
    except Exception:  # noqa: BLE001  values of another type go through their text
        raw = spark.createDataFrame([(str(v),) for (v,) in rows], "value string")
    return F.broadcast(raw.select(typed(F.col("value"), kind).alias("value")))  # a list that the driver held


def probe_values(values: DataFrame, kind: T.DataType) -> DataFrame:
    """``values`` (value) as the index's type, in which a join would find them; against text, a join compares in the other type, so these stay."""
    own = values.schema["value"].dataType
    if own == kind or isinstance(kind, T.StringType) and not isinstance(own, T.StringType):
        return values
    return values.select(typed(F.col("value"), kind).alias("value"))


def candidate_files(spark: SparkSession, meta: IndexMetadata, tables: IndexTables, column: str, values: DataFrame, latest: bool = True, few: bool = False) -> DataFrame:
    """(filename) for ``values`` (one column, value). ``latest``: of a temporal value only the file with its newest version. ``few``: a list of the driver's.

    A column that not every file has been indexed by yet leaves all files over, and so does text in a filter or range that is
    asked for values of another type.
    """
    kind = meta.kinds().get(column)
    if kind is None:
        raise ColumnNotFoundException(f"{column} has no index")
    stats = tables.stats().read()
    none = spark.createDataFrame([], "filename string")
    if stats is None:
        return none
    if column not in meta.built:
        return stats.select("filename")
    indexed = value_type(spark, meta, tables, column)
    values = probe_values(values, indexed).where("value is not null")
    mixed = isinstance(indexed, T.StringType) and not isinstance(values.schema["value"].dataType, T.StringType)
    if mixed and kind in ("range", "bloom"):
        return stats.select("filename")
    if kind == "range":
        few = values.distinct().limit(RANGE_VALUES + 1).collect()  # bounded
        if not few:
            return none
        low, high = F.col(f"range_{column}.min"), F.col(f"range_{column}.max")
        if len(few) <= RANGE_VALUES:
            exact = F.array(*(F.lit(r["value"]) for r in few))
            return stats.where(F.exists(exact, lambda v: (low <= v) & (high >= v))).select("filename")
        box = values.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        return stats.where((high >= F.lit(box["a"])) & (low <= F.lit(box["b"]))).select("filename")
    rows = tables.of(kind, column).read()
    if rows is None:
        return none
    if n := setting(spark, "indexRepartitionCount"):
        rows = rows.repartition(n)
    if not few and meta.total_size > LARGE_BYTES:
        first = F.broadcast(values.where(F.pmod(F.xxhash64("value"), F.lit(FIRST_SHARE)) == 0).limit(FIRST_VALUES))
        found = {r["filename"] for r in _holding(spark, meta, tables, column, kind, rows, first, mixed, latest).collect()}
        if found.issuperset(r["filename"] for r in stats.select("filename").collect()):
            return stats.select("filename")
    return _holding(spark, meta, tables, column, kind, rows, values, mixed, latest)


def _holding(spark: SparkSession, meta: IndexMetadata, tables: IndexTables, column: str, kind: str, rows: DataFrame, values: DataFrame, mixed: bool, latest: bool) -> DataFrame:
    """(filename) of ``rows``, a column's index, for ``values`` of its type; more values never leave less over."""
    if kind == "bloom":
        return bloom.probe(rows, values, meta.bloom[column])
    if column in meta.auto_bloom and not mixed:  # the filters are a fraction of the values
        rows = rows.join(bloom.probe(tables.of("auto_bloom", column).read(), values, setting(spark, "autoBloomFpr")), "filename", "left_semi")
    if mixed:
        rows = rows.withColumn("value", F.col("value").try_cast(values.schema["value"].dataType))
    hit = rows.join(values, "value", "left_semi")
    if kind == "temporal" and latest:
        newest = Window.partitionBy("value").orderBy(F.desc_nulls_last("max_ts"), F.desc("filename"))
        hit = hit.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    return hit.select("filename").distinct()


def locate(spark: SparkSession, meta: IndexMetadata, tables: IndexTables, wanted: dict[str, DataFrame], latest: bool = True, few: bool = False) -> DataFrame:
    """(filename) of the files that every column leaves over; nothing asked, nothing found."""
    if not wanted:
        return spark.createDataFrame([], "filename string")
    found = [candidate_files(spark, meta, tables, c, v, latest, few) for c, v in wanted.items()]
    return reduce(lambda a, b: a.join(b, "filename", "left_semi"), found)


def within_bounds(stats: DataFrame, column: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """(filename) whose range of ``column`` meets the interval."""
    a, b = F.col(f"range_{column}.min"), F.col(f"range_{column}.max")
    keep = F.lit(True)
    if low is not None:
        keep &= (b > F.lit(low)) if low_open else (b >= F.lit(low))
    if high is not None:
        keep &= (a < F.lit(high)) if high_open else (a <= F.lit(high))
    return stats.where(keep & a.isNotNull()).select("filename")
