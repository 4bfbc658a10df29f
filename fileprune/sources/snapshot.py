"""Versioned Parquet tables: immutable folders of data, and commit files that are created but never changed.

A row belongs to a key (a file of the index) and carries the version that wrote it. Replacing or removing keys only adds
a small table of removals, so an update writes no more than what is new; compaction folds removals in.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileprune.errors import FilePruneError
from fileprune.sources.fs import Files

VERSION = "_version"
#: By place: the newest commit that was read and its rows. Commits never change, so a name tells whether they still hold.
_read: dict[tuple[str, str], tuple[str, dict, DataFrame | None]] = {}


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "filename"):
        self.spark, self.path, self.key, self.files = spark, path, key, Files(spark)

    def exists(self) -> bool:
        return bool(self._commits())

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/_commits") if n.endswith(".json")]

    def _newest(self) -> dict:
        names = self._commits()
        if not names:
            if self.files.names(self.path):
                raise FilePruneError(f"{self.path} holds something else than a table")
            return {"version": 0, "parts": [], "removals": [], "schema": None}
        place = (self.spark.sparkContext.applicationId, self.path)
        known = _read.get(place)
        if known is None or known[0] != names[-1] or known[1]["mark"] != self.files.modified(f"{self.path}/_commits/{names[-1]}"):
            body = json.loads(self.files.read(f"{self.path}/_commits/{names[-1]}"))
            known = _read[place] = (names[-1], body | {"mark": self.files.modified(f"{self.path}/_commits/{names[-1]}")}, None)
        return known[1]

    def state(self) -> tuple:
        """Changes whenever the table does."""
        now = self._newest()
        return self.path, now["version"], now.get("mark")

    def _commit(self, old: dict, **change) -> None:
        new = {k: v for k, v in old.items() if k != "mark"} | change | {"version": old["version"] + 1, "time": time.time()}
        self.files.create(f"{self.path}/_commits/{new['version']:012d}.json", json.dumps(new))  # fails if another was first

    def _write(self, df: DataFrame, version: int) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{self.path}/{name}")
        return name

    @staticmethod
    def _merged(old: str | None, new: T.StructType) -> str:
        fields = list(T.StructType.fromJson(json.loads(old)).fields) if old else []
        known = {f.name for f in fields}
        return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in known]).json()

    def append(self, df: DataFrame, replacing: DataFrame | None = None) -> DataFrame:
        """Add rows; all earlier rows of the keys ``replacing`` (a column named as the table's key) go. Columns that are new are null in old rows. Returns the rows as written, without the others."""
        old = self._newest()
        part = self._write(df, old["version"] + 1)
        change = {"parts": [*old["parts"], part], "schema": self._merged(old["schema"], df.schema)}
        if replacing is not None and old["parts"]:
            change["removals"] = [*old["removals"], self._write(replacing.select(self.key).distinct(), old["version"] + 1)]
        self._commit(old, **change)
        return self.spark.read.schema(df.schema).parquet(*self._paths([part]))

    def remove(self, keys: DataFrame) -> None:
        """All rows of the keys (a column named as the table's key) go."""
        old = self._newest()
        if old["parts"]:
            self._commit(old, removals=[*old["removals"], self._write(keys.select(self.key).distinct(), old["version"] + 1)])

    def overwrite(self, df: DataFrame) -> None:
        old = self._newest()
        self._commit(old, parts=[self._write(df, old["version"] + 1)], removals=[], schema=self._merged(None, df.schema))

    def _paths(self, names: list[str]) -> list[str]:
        return [f"{self.path}/{n}" for n in names]

    def schema(self) -> T.StructType | None:
        text = self._newest()["schema"]
        return T.StructType.fromJson(json.loads(text)) if text else None

    def read(self) -> DataFrame | None:
        """The newest snapshot; None if nothing was ever written."""
        now = self._newest()
        if not now["schema"]:
            return None
        place = (self.spark.sparkContext.applicationId, self.path)
        name, body, rows = _read[place]
        if rows is None:
            rows = self._rows(now)
            _read[place] = (name, body, rows)
        return rows

    def _rows(self, now: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        versioned = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
        rows = self.spark.read.schema(versioned).parquet(*self._paths(now["parts"])) if now["parts"] else self.spark.createDataFrame([], versioned)
        if now["removals"]:
            key_type = next(f.dataType for f in schema.fields if f.name == self.key)
            gone = self.spark.read.schema(T.StructType([T.StructField(self.key, key_type), T.StructField(VERSION, T.LongType())])).parquet(*self._paths(now["removals"]))
            gone = gone.groupBy(self.key).agg(F.max(VERSION).alias("_gone"))
            rows = rows.join(gone, self.key, "left").where(F.col("_gone").isNull() | (F.col(VERSION) >= F.col("_gone")))
        return rows.select(*(F.col(f"`{f.name}`") for f in schema.fields if f.name != VERSION))

    def compact(self) -> None:
        """Rewrite the newest snapshot without what was removed, in as few files as adaptive execution makes."""
        rows = self.read()
        if rows is not None:
            self.overwrite(rows.repartition(self.key))

    def vacuum(self, hours: float = 168) -> None:
        """Delete data and commits that the newest commit doesn't use and that are older than that."""
        names = self._commits()
        if not names:
            return
        now, limit = self._newest(), (time.time() - max(0.0, hours) * 3600) * 1000
        used = set(now["parts"]) | set(now["removals"])
        for name in self.files.names(f"{self.path}/data"):
            if f"data/{name}" not in used and (hours <= 0 or self.files.modified(f"{self.path}/data/{name}") < limit):
                self.files.delete(f"{self.path}/data/{name}")
        for name in names[:-1]:
            if hours <= 0 or self.files.modified(f"{self.path}/_commits/{name}") < limit:
                self.files.delete(f"{self.path}/_commits/{name}")
