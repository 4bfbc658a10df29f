"""Building the index tables of some files.

``file_stats`` has a row for each file: its size, its rows, distinct counts and ranges; it is written last, so a file is
indexed once it is there. ``postings/<column>`` has (filename, value), ``temporal/<column>`` (filename, value, max_ts),
``bloom/<column>`` the words of filters. A batch only adds to these tables.

Parquet sources are read column by column, so each column once. Of text formats the indexed columns are staged first, as
text would have to be parsed anew for each. What a batch has finished is noted beside the tables: if it fails, the next
update of the same files goes on after the last finished column.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileprune.conf import setting
from fileprune.functions import bloom
from fileprune.plans.metadata import IndexMetadata
from fileprune.sources import reader
from fileprune.sources.fs import Files
from fileprune.sources.snapshot import SnapshotTable


class IndexTables:
    """The tables of one index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stats(self) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.path}/file_stats")

    def of(self, kind: str, column: str) -> SnapshotTable:
        folder = {"bloom": "bloom", "auto_bloom": "auto_bloom", "temporal": "temporal"}.get(kind, "postings")
        return SnapshotTable(self.spark, f"{self.path}/{folder}/{column}")

    def all(self, meta: IndexMetadata) -> list[SnapshotTable]:
        out = [self.of(kind, c) for c, kind in meta.kinds().items() if kind != "range"]
        return [self.stats(), *out, *(self.of("auto_bloom", c) for c in meta.auto_bloom)]


def source_rows(spark: SparkSession, meta: IndexMetadata, files: list[str]) -> DataFrame:
    df = reader.with_file(reader.base(spark, meta, files))
    df = reader.with_computed(df, meta)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if setting(spark, "repartitionDataFiles") else df


def values_of(rows: DataFrame, meta: IndexMetadata, column: str) -> DataFrame:
    """Distinct (filename, value) of a regular, computed or exploded column, nulls left out."""
    value = F.col(f"`{column}`")
    if column in meta.aliases():
        x = next(x for x in meta.exploded if x["as_column"] == column)
        value = F.explode(F.col(f"{x['array_column']}.{x['field_path']}"))
    return rows.select(F.col(reader.FILE).alias("filename"), value.alias("value")).where("value is not null").distinct()


def analyze(spark: SparkSession, meta: IndexMetadata, files: list[str]) -> dict[str, dict[str, int]]:
    """Distinct values of each valued column in each file."""
    rows, out = source_rows(spark, meta, files), {f: {} for f in files}
    for column in meta.valued():
        values = rows.select(F.col(reader.FILE).alias("filename"), F.col(f"`{column}`").alias("value")).where("value is not null").distinct() if column in meta.temporal else values_of(rows, meta, column)
        counts = values.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        for f in files:
            out[f][column] = 0
        for r in counts:
            out[r["filename"]][column] = r["n"]
    return out


def distinct_counts(tables: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """By column and file the rows of (filename, value) tables, counted in one job: a row for each file and column."""
    out: dict[str, dict[str, int]] = {c: {} for c in tables}
    if tables:
        counts = [t.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "filename", "n") for c, t in tables.items()]
        for r in reduce(DataFrame.unionAll, counts).collect():
            out[r["column"]][r["filename"]] = r["n"]
    return out


class Staging:
    """What a batch of files has finished, and its staged rows: a folder that goes when the batch is done."""

    def __init__(self, spark: SparkSession, tables: IndexTables, files: list[str]):
        self.spark, self.files = spark, Files(spark)
        self.path = f"{tables.path}/staging/{hashlib.sha256(chr(10).join(sorted(files)).encode()).hexdigest()[:32]}"
        self.note = f"{self.path}/done.json"
        self.done: dict[str, str] = json.loads(self.files.read(self.note)) if self.files.exists(self.note) else {}

    def finished(self, column: str, kind: str) -> bool:
        return self.done.get(column) == kind

    def finish(self, column: str, kind: str) -> None:
        self.done[column] = kind
        self.files.replace(self.note, json.dumps(self.done))

    def rows(self, meta: IndexMetadata, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns that indexes use; those of text formats staged as Parquet."""
        needed = [reader.FILE, *meta.indexes, *meta.bloom, *meta.range, *meta.temporal, *meta.computed, *(x["array_column"] for x in meta.exploded), *(ts.split(".")[0] for ts in meta.temporal.values())]
        narrow = rows.select(*(F.col(f"`{c}`") for c in dict.fromkeys(needed)))
        if meta.format == "parquet" or len(meta.kinds()) < 2:
            return narrow
        place = f"{self.path}/rows-{hashlib.sha256(meta.dump().encode()).hexdigest()[:16]}"
        if not self.files.exists(f"{place}/_SUCCESS"):
            narrow.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(narrow.schema).parquet(place)

    def clear(self) -> None:
        self.files.delete(self.path)


def build_batch(spark: SparkSession, meta: IndexMetadata, tables: IndexTables, sizes: dict[str, int]) -> None:
    """Index the files of ``sizes`` (canonical URI -> bytes); rows of theirs that are there already are replaced, also where nothing replaces them."""
    staging = Staging(spark, tables, list(sizes))
    rows = staging.rows(meta, source_rows(spark, meta, list(sizes)))
    named = spark.createDataFrame(list(sizes.items()), "filename string, file_size long")
    files = named.select("filename")
    written: dict[str, DataFrame] = {}  # of each valued column the batch's own rows, so that other batches aren't read again
    for column, kind in meta.kinds().items():
        if kind == "range":
            continue
        table = tables.of(kind, column)
        if not staging.finished(column, kind):
            if kind == "temporal":
                ts = F.col(meta.temporal[column])
                built = rows.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(reader.FILE).alias("filename"), F.col(f"`{column}`").alias("value")).agg(F.max(ts).alias("max_ts"))
            elif kind == "bloom":
                plain = rows.select(F.col(reader.FILE).alias("filename"), F.col(f"`{column}`").alias("value")).distinct()
                built = bloom.build(plain, meta.bloom[column])
            else:
                built = values_of(rows, meta, column)
            mine = table.append(built, replacing=files)
            staging.finish(column, kind)
        else:
            mine = table.read().join(files, "filename", "left_semi")
        if kind != "bloom":
            written[column] = mine
    counts = distinct_counts(written)
    limit = setting(spark, "largeIndexLimit")
    stats = rows.groupBy(F.col(reader.FILE).alias("filename")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.struct(F.min(F.col(f"`{c}`")).alias("min"), F.max(F.col(f"`{c}`")).alias("max")).alias(f"range_{c}") for c in meta.range))
    stats = named.join(stats, "filename", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    if written:
        counted = spark.createDataFrame([(f, *(counts[c].get(f, 0) for c in written)) for f in sizes], ", ".join(["filename string", *(f"`nd_{c}` long" for c in written)]))
        stats = stats.join(counted, "filename", "left")
    eligible = [c for c in meta.valued() if c not in meta.temporal]
    if eligible:
        new = [c for c in eligible if max(counts[c].values(), default=0) >= limit and c not in meta.auto_bloom]
        for column in [*meta.auto_bloom, *new]:
            # a column's first filters are those of all files, as location takes a file without one for one without the value
            values = tables.of("regular", column).read() if column in new else written[column]
            tables.of("auto_bloom", column).append(bloom.build(values, setting(spark, "autoBloomFpr")), replacing=files)
        meta.auto_bloom += new
    tables.stats().append(stats, replacing=files)
    staging.clear()
