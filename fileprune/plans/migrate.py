"""Bringing the storage of an index that an earlier version wrote up to date.

Version 1 kept no file sizes; they are asked of the file system, by the executors. Version 2 kept the values of an exploded
field under the name of its array column; they move under the alias. Version 3 kept filters word by word; they go, and the next
update builds them anew, until when their columns prune nothing. Each step is verified before the version goes up, and can
be repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileprune.errors import StorageMigrationException
from fileprune.operators.build import IndexTables
from fileprune.plans.metadata import IndexMetadata
from fileprune.sources.fs import Files, canonical_column, readable


def file_sizes(spark: SparkSession, names: DataFrame) -> DataFrame:
    """(filename, file_size) of existing files of ``names`` (filename); their contents aren't read."""
    paths = [readable(r["filename"]) for r in names.collect()]  # a scan is planned over them
    if not paths:
        return spark.createDataFrame([], "filename string, file_size long")
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    return found.select(canonical_column(F.col("_metadata.file_path")).alias("filename"), F.col("length").alias("file_size"))


def _sizes(spark: SparkSession, meta: IndexMetadata, tables: IndexTables) -> None:
    stats = tables.stats().read()
    if stats is None:
        return
    known = stats.withColumn("file_size", F.col("file_size") if "file_size" in stats.columns else F.lit(None).cast("long"))
    missing = known.where("file_size is null")
    present = {r["filename"] for r in missing.select("filename").collect()}
    files = Files(spark)
    sizes = file_sizes(spark, missing.select("filename").where(F.col("filename").isin(*(f for f in present if files.exists(readable(f)))))) if present else None
    if sizes is None:
        return
    filled = known.join(sizes.withColumnRenamed("file_size", "_size"), "filename", "left").withColumn("file_size", F.coalesce("file_size", "_size", F.lit(0))).drop("_size")
    tables.stats().overwrite(filled)
    if not tables.stats().read().where("file_size is null").isEmpty():
        raise StorageMigrationException("files without a size are left")


def _aliases(spark: SparkSession, meta: IndexMetadata, tables: IndexTables) -> None:
    files = Files(spark)
    for x in meta.exploded:
        old, new = f"{tables.path}/postings/{x['array_column']}", f"{tables.path}/postings/{x['as_column']}"
        if x["array_column"] != x["as_column"] and x["array_column"] not in meta.kinds() and files.exists(old) and not files.exists(new):
            files.rename(old, new)
        if x["as_column"] in meta.built and tables.stats().exists() and not files.exists(new):
            raise StorageMigrationException(f"the values of {x['as_column']} are missing")


def _filters(spark: SparkSession, meta: IndexMetadata, tables: IndexTables) -> None:
    files = Files(spark)
    for kind, columns in (("bloom", list(meta.bloom)), ("auto_bloom", meta.auto_bloom)):
        for column in columns:
            files.delete(tables.of(kind, column).path)
    meta.built = [c for c in meta.built if c not in meta.bloom]
    meta.auto_bloom = []


#: By the version that a step starts from.
STEPS = {1: _sizes, 2: _aliases, 3: _filters}


def migrate(spark: SparkSession, meta: IndexMetadata, tables: IndexTables) -> None:
    """All steps from ``meta``'s storage version on, whose version goes up with each."""
    try:
        while (step := STEPS.get(meta.storage_format_version)) is not None:
            step(spark, meta, tables)
            meta.storage_format_version += 1
    except StorageMigrationException:
        raise
    except Exception as e:
        raise StorageMigrationException(f"from storage version {meta.storage_format_version}: {e}") from e
