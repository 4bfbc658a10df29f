"""The ledger of an index's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileprune.errors import FileListNotFoundException
from fileprune.sources.fs import Files
from fileprune.sources.paths import file_list_path, validated
from fileprune.sources.snapshot import SnapshotTable

SCHEMA = "filename string not null, file_size long, addedAt timestamp not null"


class FileList:
    """Files by canonical URI, with size and the time when they were first added."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, validated(name)
        self.table = SnapshotTable(spark, file_list_path(spark, name))

    @property
    def files(self) -> DataFrame:
        rows = self.table.read()
        return self.spark.createDataFrame([], SCHEMA) if rows is None else rows

    def _resolved(self, paths: tuple[str, ...]) -> dict[str, int]:
        if any(p is None or not str(p).strip() for p in paths):
            raise ValueError("a file name must not be blank")
        found = Files(self.spark)
        return dict(x for p in paths for x in found.expanded(str(p).strip()))

    def add_file(self, *paths: str) -> None:
        """Add what isn't there yet; folders and patterns stand for their files."""
        named = self._resolved(paths)
        if not named:
            return
        rows = self.spark.createDataFrame(list(named.items()), "filename string, file_size long")
        new = rows.join(self.files.select("filename"), "filename", "left_anti").withColumn("addedAt", F.current_timestamp())
        if not new.isEmpty():
            self.table.append(new)

    def remove_file(self, *paths: str) -> None:
        self.remove_names(list(self._resolved(paths)))

    def remove_names(self, names: list[str]) -> None:
        """Remove files by their canonical URIs."""
        if names and self.table.exists():
            self.table.remove(self.spark.createDataFrame([(n,) for n in names], "filename string"))

    def has_file(self, path: str) -> bool:
        return not self.files.where(F.col("filename").isin(*self._resolved((path,)))).isEmpty()

    @staticmethod
    def exists(spark: SparkSession, name: str) -> bool:
        return SnapshotTable(spark, file_list_path(spark, name)).exists()

    @staticmethod
    def remove(spark: SparkSession, name: str) -> bool:
        if not FileList.exists(spark, name):
            raise FileListNotFoundException(name)
        return Files(spark).delete(file_list_path(spark, name))
