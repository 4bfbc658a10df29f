"""Reading pruned files, and keeping the latest version of temporal keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileprune.operators.build import IndexTables
from fileprune.plans.metadata import IndexMetadata
from fileprune.sources import reader


def read_files(spark: SparkSession, meta: IndexMetadata, files: Iterable[str], aliases: Iterable[str] = (), selected: list[str] | None = None, keep_file: bool = False, mark: str | None = None) -> DataFrame:
    """Source rows with computed columns and the wanted exploded aliases; of a selection those columns, and what dedup needs."""
    df = reader.base(spark, meta, files, mark)
    df = reader.with_exploded(reader.with_computed(reader.with_file(df) if keep_file else df, meta), meta, aliases)
    if selected is None:
        return df
    roots = [ts.split(".")[0] for ts in meta.temporal.values()]
    names = [*dict.fromkeys([*selected, *aliases, *roots]), *([reader.FILE] if keep_file else [])]
    return df.select(*(F.col(f"`{c}`") for c in names))


def _payload(df: DataFrame) -> Column:
    """A hash of the row; maps have none, so they go through their text."""
    plain = [f.name for f in df.schema.fields if f.name != reader.FILE and "map<" not in f.dataType.simpleString()]
    maps = [f.name for f in df.schema.fields if f.name != reader.FILE and f.name not in plain]
    return F.xxhash64(*(F.col(f"`{c}`") for c in plain), *(F.to_json(F.struct(F.col(f"`{c}`"))) for c in maps))


def latest_only(df: DataFrame, meta: IndexMetadata, tables: IndexTables, columns: list[str], asked: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows that are the latest of their value in each of the temporal ``columns``.

    The latest timestamp of a value is that of all indexed files, also of those that other predicates pruned, and of the
    rows themselves where they are later or the index doesn't have the value yet. Ranks are taken of the rows as read and
    hold together. Ties go by file, then by a hash of the row. Needs the file column. ``asked``: by column the only values
    (value) that matter, so that no more of the index is grouped.
    """
    ranks, payload = [], _payload(df)
    for i, column in enumerate(columns):
        ts, every = F.col(meta.temporal[column]), tables.of("temporal", column).read()
        newest = F.lit(True)
        if every is not None:
            value, most = f"_fp_value_{i}", f"_fp_most_{i}"
            if asked and column in asked:
                every = every.join(asked[column], "value", "left_semi")
            latest = every.groupBy(F.col("value").alias(value)).agg(F.max("max_ts").alias(most))
            df = df.join(latest, F.col(f"`{column}`") == F.col(value), "left")
            newest = F.col(most).isNull() | F.coalesce(ts >= F.col(most), F.lit(False))
        df = df.withColumn(f"_fp_ok_{i}", newest)
        order = Window.partitionBy(f"`{column}`").orderBy(ts.desc_nulls_last(), F.desc(reader.FILE), payload.desc())
        ranks.append(F.when(F.col(f"_fp_ok_{i}"), F.row_number().over(order)))
        df = df if every is None else df.drop(value, most)
    for i, rank in enumerate(ranks):
        df = df.withColumn(f"_fp_rank_{i}", rank)
    for i in range(len(columns)):
        df = df.where(F.col(f"_fp_rank_{i}") == 1)
    return df.drop(*(f"_fp_rank_{i}" for i in range(len(columns))), *(f"_fp_ok_{i}" for i in range(len(columns))))
