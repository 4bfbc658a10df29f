"""Reading source files with the declared schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileprune.plans.metadata import IndexMetadata
from fileprune.sources.fs import canonical_column, readable

FORMATS = ("csv", "parquet", "json")
#: A reader's option that says which index a scan belongs to: readers ignore it, plans show it.
MARK = "fileprunename"
#: Where rows carry their file while an index works on them.
FILE = "_fileprune_file"


def base(spark: SparkSession, meta: IndexMetadata, files: Iterable[str], mark: str | None = None) -> DataFrame:
    """The rows of the files; without files an empty table of the same schema. ``mark``: a name that the scan carries."""
    schema = T.StructType.fromJson(meta.schema_json())
    paths = [readable(f.strip()) for f in files if f and f.strip()]
    if not paths:
        return spark.createDataFrame([], schema)
    if meta.format not in FORMATS:
        raise ValueError(f"Unsupported format: {meta.format}")
    return spark.read.schema(schema).options(**meta.read_options | ({MARK: mark} if mark else {})).format(meta.format).load(sorted(paths))


def with_file(df: DataFrame) -> DataFrame:
    """Rows with their file's canonical URI. Must be asked of a file scan."""
    if not df.inputFiles():
        return df.withColumn(FILE, F.lit(None).cast("string"))
    return df.withColumn(FILE, canonical_column(F.col("_metadata.file_path")))


def with_computed(df: DataFrame, meta: IndexMetadata) -> DataFrame:
    for name, expression in meta.computed.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def with_exploded(df: DataFrame, meta: IndexMetadata, aliases: Iterable[str]) -> DataFrame:
    """One row for each element; several aliases multiply; rows without elements go."""
    wanted = set(aliases)
    for x in meta.exploded:
        if x["as_column"] in wanted:
            df = df.withColumn(x["as_column"], F.explode(F.col(f"{x['array_column']}.{x['field_path']}")))
    return df
