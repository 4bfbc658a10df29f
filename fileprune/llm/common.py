"""What the operators of this subpackage share: scratch tables, global row numbers, label folds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words, as every operator here counts them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: monotonically_increasing_id() keeps the row number within a partition in its low 33 bits.
_ROW_BITS = 33
#: Bytes of text that training takes at most, beside its bound of rows.
TRAINING_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.fileprune.scratchDir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="fileprune-")
            spark.conf.set("spark.fileprune.scratchDir", root)
    return f"{root.rstrip('/')}/fileprune-scratch-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and fixes what non-deterministic plans made."""
    return Scratch(df.sparkSession, name).written(df, name, compression)


class Scratch:
    """Tables in the shared folder. As a context it deletes them at its end, so nothing that is still to be read may depend on them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{self.path}/{len(self._paths)}-{name}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``written`` gave."""
        for held, path in self._paths:
            if held is df:
                _delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Within, jobs hand at most so many rows to Python at a time: for tables with long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Call it when no result that reads them is needed any more."""
    _delete(spark, scratch_root(spark))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; 0 (that of no bytes) for null."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0)).cast("int")


def global_rank(df: DataFrame, order: list[Column], name: str, rank: str) -> DataFrame:
    """``df`` with a gapless row number from 0 in ``order``, without a window over everything.

    Rows are dealt out by range and sorted in their partition, then written, so that the numbers can't change when an
    executor is lost. The start of a partition is the sum of the counts before it: one row a partition is all that
    meets in one task. Rows equal in all of ``order`` are interchangeable; a random last key spreads them.
    """
    tie, mark = unused(df, "_tie"), unused(df, "_mark")
    keys = [*order, F.col(tie).asc()]
    dealt = df.withColumn(tie, F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    kept = written(dealt.withColumn(mark, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(mark), _ROW_BITS).alias("_part")
    starts = (
        kept.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    )
    spread = starts.withColumnRenamed("_part", part_name := unused(df, "_part_no")).withColumnRenamed("_start", start := unused(df, "_start_no"))
    # one row for each partition that was written, so never more than there are tasks
    joined = kept.withColumn(part_name, F.shiftright(F.col(mark), _ROW_BITS)).join(F.broadcast(spread), part_name)
    return joined.withColumn(rank, F.col(start) + F.col(mark).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop(part_name, start, mark)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, most_bytes: int = TRAINING_BYTES) -> list[tuple[str, int]]:
    """At most ``limit`` (text, label) rows outside the held-out fold, taken in the order of a hash of their doc_id, of ``most_bytes`` together.

    The bounds are documented parameters; only these rows come to the driver. Null labels and null doc_ids
    take no part, a document labelled more than once counts once with its largest label.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where("_id is not null and _y is not null")
        .where(fold(F.col("_id"), folds) != held_out)
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    order = [F.xxhash64(F.lit("sample"), F.col("_id")), F.col("_id")]
    chosen = known.orderBy(*order).limit(limit)
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")  # at most ``limit`` rows
        .groupBy("_id")
        .agg(F.max("_text").alias("_text"), F.max("_y").alias("_y"))
        .withColumn("_bytes", F.sum(F.octet_length("_text")).over(Window.orderBy(*order)))  # of ``limit`` rows
        .where(F.col("_bytes") <= most_bytes)
        .collect()
    )
    return [(r["_text"], int(r["_y"])) for r in sorted(rows, key=lambda r: r["_id"])]

