"""The index handle: definition, update, location, joins and scans."""

from __future__ import annotations

import copy
import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileprune.conf import setting
from fileprune.errors import (
    ColumnNotFoundException,
    FileListNotFoundException,
    FormatMismatchException,
    IndexNotFoundException,
    IndexNotFoundInNewSchemaException,
    MetadataMissingOrCorruptException,
    MissingFormatException,
    SchemaMismatchException,
    SchemaNotProvidedException,
)
from fileprune.functions.schema import field_exists, field_type
from fileprune.operators import build, locate
from fileprune.operators.join import latest_only, read_files
from fileprune.plans.metadata import STORAGE_VERSION, IndexMetadata
from fileprune.plans.migrate import migrate
from fileprune.plans.planner import byte_batches, create_batches
from fileprune.sources import reader
from fileprune.sources.filelist import FileList
from fileprune.sources.fs import Files
from fileprune.sources.lock import IndexLock
from fileprune.sources.paths import file_list_name, index_path

log = logging.getLogger(__name__)
#: Joins whose result has no values but those of both sides.
PROBED = {"inner", "leftsemi", "left_semi", "semi"}
#: Where ``batchedUpdate`` is unset, a batch has so many bytes: enough for all cores, as batches go one after the other.
BATCHED_BYTES = 16 << 30
#: Names that the stored tables use themselves.
RESERVED = {"filename", "file_size", "n_rows", "value", "max_ts", "_version", reader.FILE}


@dataclass(frozen=True)
class PruneReport:
    """What a location left over."""

    files: int
    files_total: int
    bytes: int
    bytes_total: int

    @property
    def saved_percent(self) -> float:
        return round(100 * (1 - self.bytes / self.bytes_total), 1) if self.bytes_total else 0.0


class FileIndex:
    """A named index over CSV, JSON or Parquet files. The handle isn't safe for several threads; ``select`` gives a new one."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType | None = None, format: str | None = None, read_options: dict[str, str] | None = None, allow_schema_mismatch: bool = False):
        self.spark, self.name = spark, name
        self.path = index_path(spark, name)
        self.files, self.tables = Files(spark), build.IndexTables(spark, self.path)
        self.file_list = FileList(spark, file_list_name(name))
        self.selected: list[str] | None = None
        self._last_files: set[str] | None = None
        self._meta = self._opened(schema, format, read_options or {}, allow_schema_mismatch)

    # --- definition -------------------------------------------------------------------------------------------------

    @property
    def _meta_path(self) -> str:
        return f"{self.path}/metadata.json"

    def _opened(self, schema, format, options, allow) -> IndexMetadata:
        if not self.files.exists(self._meta_path):
            if schema is None:
                raise SchemaNotProvidedException(f"{self.name} is new and needs a schema")
            if not format:
                raise MissingFormatException(f"{self.name} is new and needs a format")
            meta = IndexMetadata(format, schema.json(), dict(options))
            self._save(meta)
            return meta
        meta = self._migrated(self.refreshed())
        changed = False
        if format and format != meta.format:
            raise FormatMismatchException(f"{self.name} has the format {meta.format}, not {format}")
        if schema is not None and json.loads(schema.json()) != meta.schema_json():
            if not allow:
                raise SchemaMismatchException(f"{self.name} has another schema")
            needed = [*meta.indexes, *meta.bloom, *meta.range, *meta.temporal, *meta.temporal.values(), *(x["array_column"] for x in meta.exploded)]
            for column in needed:
                if not field_exists(schema, column):
                    raise IndexNotFoundInNewSchemaException(f"{column} is indexed and isn't in the new schema")
            meta.schema, changed = schema.json(), True
        if any(meta.read_options.get(k) != v for k, v in options.items()):
            meta.read_options, changed = meta.read_options | options, True
        if changed:
            self._save(meta)
        return meta

    def _migrated(self, meta: IndexMetadata) -> IndexMetadata:
        """Storage of an earlier version is brought up to date, under the lock and its heartbeat, by whoever comes first."""
        if meta.storage_format_version >= STORAGE_VERSION:
            return meta
        with self._lock("update").held(heartbeat=True):
            meta = self.refreshed()
            migrate(self.spark, meta, self.tables)
            self._save(meta)
        return meta

    def refreshed(self) -> IndexMetadata:
        try:
            return IndexMetadata.parse(self.files.read(self._meta_path))
        except MetadataMissingOrCorruptException:
            raise
        except Exception as e:
            if type(e).__module__ == "fileprune.errors":
                raise
            raise MetadataMissingOrCorruptException(f"{self.name}: {e}") from e

    def _save(self, meta: IndexMetadata) -> None:
        self.files.replace(self._meta_path, meta.dump())

    def _change(self, apply: Callable[[IndexMetadata], None]) -> None:
        """Apply a change to the metadata as stored now, which another handle may have changed since this one read it."""
        with self._lock("metadata").held():
            meta = self.refreshed()
            apply(meta)
            self._save(meta)
            self._meta = meta

    @property
    def metadata(self) -> IndexMetadata:
        return self._meta

    @property
    def format(self) -> str:
        return self._meta.format

    @property
    def schema(self) -> T.StructType:
        return self._meta.struct()

    @property
    def indexes(self) -> set[str]:
        return set(self._meta.kinds())

    def _define(self, column: str, kind: str, top_level: bool = True) -> bool:
        """Whether the name is still free; False if it has this kind already."""
        if column is None or not column.strip():
            raise ValueError("a column name must not be blank")
        if column in RESERVED or column.startswith("_fp_"):
            raise ValueError(f"{column} is a reserved name")
        if "." in column:
            raise ValueError(f"{column}: only top-level columns can be indexed")
        self._meta = self.refreshed()
        now = self._meta.kinds().get(column)
        if now == kind:
            return False
        if now is not None:
            raise ValueError(f"{column} has a {now} index and can't have a {kind} index too")
        if top_level and column not in self.schema.names:
            raise ColumnNotFoundException(f"{column} isn't in the schema")
        return True

    def add_index(self, column: str) -> None:
        """Exact values of each file."""
        if self._define(column, "regular"):
            self._change(lambda meta: meta.indexes.append(column))

    def add_bloom_index(self, column: str, fpr: float = 0.01) -> None:
        if not 0 < fpr < 1:
            raise ValueError("fpr must lie between 0 and 1")
        if self._define(column, "bloom"):
            self._change(lambda meta: meta.bloom.update({column: fpr}))

    def add_range_index(self, column: str) -> None:
        """Least and greatest value of each file."""
        if self._define(column, "range"):
            self._change(lambda meta: meta.range.append(column))

    def add_temporal_index(self, column: str, ts_column: str) -> None:
        """Latest timestamp of each value in each file; joins on the column see latest versions only."""
        if ts_column is None or not ts_column.strip():
            raise ValueError("a timestamp column must not be blank")
        if self._define(column, "temporal"):
            if not field_exists(self.schema, ts_column):
                raise ColumnNotFoundException(f"{ts_column} isn't in the schema")
            self._change(lambda meta: meta.temporal.update({column: ts_column}))

    def add_computed_index(self, name: str, expression: str) -> None:
        """Values of a Spark SQL expression."""
        if expression is None or not expression.strip():
            raise ValueError("an expression must not be blank")
        if self._define(name, "computed", top_level=False):
            self._change(lambda meta: meta.computed.update({name: expression}))

    def add_exploded_field_index(self, array_column: str, field_path: str, as_column: str) -> None:
        """Values of a field of an array's structs, joined under an alias."""
        if not (array_column or "").strip() or not (field_path or "").strip():
            raise ValueError("an array column and a field must be named")
        if self._define(as_column, "exploded", top_level=False):
            kind = field_type(self.schema, array_column)
            if kind is None:
                raise ColumnNotFoundException(f"{array_column} isn't in the schema")
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"{array_column} isn't an array")
            if not isinstance(kind.elementType, T.StructType) or not field_exists(kind.elementType, field_path):
                raise ColumnNotFoundException(f"the elements of {array_column} have no field {field_path}")
            self._change(lambda meta: meta.exploded.append({"array_column": array_column, "field_path": field_path, "as_column": as_column}))

    def select(self, *columns: str) -> FileIndex:
        """A handle whose joins and scans give these columns only."""
        for c in columns:
            if c not in self.schema.names and c not in self._meta.computed and c not in self._meta.aliases():
                raise ColumnNotFoundException(f"{c} is neither in the schema nor an alias")
        other = copy.copy(self)
        other.selected = list(columns)
        return other

    # --- files ------------------------------------------------------------------------------------------------------

    def _lock(self, name: str) -> IndexLock:
        return IndexLock(self.spark, f"{self.path}/.{name}.lock")

    def add_file(self, *paths: str) -> None:
        with self._lock("filelist").held():
            self.file_list.add_file(*paths)

    def has_file(self, path: str) -> bool:
        return self.file_list.has_file(path)

    def _unindexed(self) -> DataFrame:
        stats, files = self.tables.stats().read(), self.file_list.files
        return files if stats is None else files.join(stats.select("filename"), "filename", "left_anti")

    def unindexed_files(self) -> set[str]:
        return {r["filename"] for r in self._unindexed().select("filename").collect()}

    def columns_to_backfill(self) -> set[str]:
        """Indexed columns that files indexed earlier lack."""
        return set() if self.tables.stats().read() is None else self.indexes - set(self._meta.built)

    def update(self) -> int:
        """Index what isn't indexed yet, after filling in columns that were added since. Returns the number of files read."""
        with self._lock("update").held(heartbeat=True) as lock:
            self._meta = meta = self.refreshed()
            sizes: dict[str, int] = {}
            if self.columns_to_backfill():
                sizes |= {r["filename"]: r["file_size"] for r in self.tables.stats().read().select("filename", "file_size").collect()}
            sizes |= {r["filename"]: r["file_size"] for r in self._unindexed().select("filename", "file_size").collect()}
            if not sizes:
                return 0
            batches = self._batches(meta, sizes)
            for i, batch in enumerate(batches, 1):
                build.build_batch(self.spark, meta, self.tables, {f: sizes[f] for f in batch})
                if (every := setting(self.spark, "lockRefreshInterval")) and i % max(1, every) == 0:
                    lock.refresh(strict=True)
            count = meta.batches_since_compact + len(batches)
            limit = setting(self.spark, "autoCompactThreshold")
            if limit is not None and count >= limit:
                self._compact(meta)
                count = 0
            elif limit is None and count >= 50:
                log.warning("%s: %d batches since the last compaction", self.name, count)
            total = self._summed_size()

            def done(stored: IndexMetadata) -> None:
                stored.built = sorted(set(meta.kinds()) & set(stored.kinds()))
                stored.auto_bloom = list(dict.fromkeys([*stored.auto_bloom, *meta.auto_bloom]))
                stored.total_size, stored.batches_since_compact = total, count

            self._change(done)
            return len(sizes)

    def _batches(self, meta: IndexMetadata, sizes: dict[str, int]) -> list[list[str]]:
        """Files that are indexed together: by their distinct values where ``batchedUpdate`` says so, by bytes where it is unset, else all."""
        asked = setting(self.spark, "batchedUpdate")
        if asked:
            return create_batches(build.analyze(self.spark, meta, sorted(sizes)), setting(self.spark, "largeIndexLimit"))
        return [sorted(sizes)] if asked is False else byte_batches(sizes, BATCHED_BYTES)

    def _summed_size(self) -> int:
        stats = self.tables.stats().read()
        return int(stats.agg(F.sum("file_size")).first()[0] or 0) if stats is not None else 0

    def delete_files(self, *paths: str) -> None:
        """Forget files in every table and in the ledger; names that aren't known are ignored."""
        if not paths or any(p is None or not p.strip() for p in paths):
            raise ValueError("files must be named")
        with self._lock("update").held():
            self._meta = self.refreshed()
            names = [(n,) for p in paths for n, _ in self.files.expanded(p.strip())]
            gone = self.spark.createDataFrame(names, "filename string")
            for table in reversed(self.tables.all(self._meta)):
                if table.exists():
                    table.remove(gone)
            with self._lock("filelist").held():
                self.file_list.remove_names([n for (n,) in names])
            total = max(0, self._summed_size())
            self._change(lambda meta: setattr(meta, "total_size", total))

    def _compact(self, meta: IndexMetadata) -> None:
        for table in self.tables.all(meta):
            if table.exists():
                table.compact()

    def compact(self) -> None:
        with self._lock("update").held(heartbeat=True):
            self._meta = self.refreshed()
            self._compact(self._meta)
            self._change(lambda meta: setattr(meta, "batches_since_compact", 0))

    def vacuum(self, hours: float = 168) -> None:
        with self._lock("update").held():
            for table in [*self.tables.all(self._meta), self.file_list.table]:
                if table.exists():
                    table.vacuum(hours)

    # --- queries ----------------------------------------------------------------------------------------------------

    def locate(self, wanted: dict[str, list] | DataFrame, latest: bool = True) -> DataFrame:
        """(filename) of files that may hold all of the wanted columns' values: lists by column, or a table of those columns.

        ``latest``: of a temporal column only the file with a value's newest version, else every file that has it.
        """
        tables = {}
        for c in wanted.columns if isinstance(wanted, DataFrame) else wanted:
            if c not in self.indexes:
                raise ColumnNotFoundException(f"{c} has no index")
            if isinstance(wanted, DataFrame):
                tables[c] = wanted.select(F.col(f"`{c}`").alias("value"))
            else:
                tables[c] = locate.literal_values(self.spark, list(wanted[c]), locate.value_type(self.spark, self._meta, self.tables, c))
        return locate.locate(self.spark, self._meta, self.tables, tables, latest, few=not isinstance(wanted, DataFrame))

    def locate_files(self, wanted: dict[str, list] | DataFrame) -> set[str]:
        """The names themselves: as many as the scan that follows will read."""
        return {r["filename"] for r in self.locate(wanted).collect()}

    @property
    def last_report(self) -> PruneReport | None:
        """What the last join or scan read, of what there is; counted when it is asked for."""
        return None if self._last_files is None else self.report_of(self._last_files)

    def report_of(self, files: set[str]) -> PruneReport | None:
        """``files`` against all that are indexed."""
        stats = self.tables.stats().read()
        if stats is None:
            return None
        named = self.spark.createDataFrame([(f, True) for f in files], "filename string, read boolean")
        r = stats.join(named, "filename", "left").agg(F.count("read"), F.count(F.lit(1)), F.sum(F.when(F.col("read"), F.col("file_size"))), F.sum("file_size")).first()
        return PruneReport(r[0], r[1], int(r[2] or 0), int(r[3] or 0))

    def _reported(self, files: set[str]) -> set[str]:
        self._last_files = files
        if setting(self.spark, "debug"):
            log.info("%s: %s", self.name, self.last_report)
        return files

    def _pruned(self, df: DataFrame, using: list[str], scope: str, explode: str, how: str) -> DataFrame:
        for c in using:
            known = self.selected if self.selected is not None else [*self.schema.names, *self._meta.computed, *self._meta.aliases()]
            if c not in known and c not in self.indexes or self.selected is not None and c not in self.selected and c in self.schema.names:
                raise ColumnNotFoundException(f"{c} isn't a column of {self.name}")
        keys = [c for c in using if c in self.indexes]
        if not keys:
            raise ValueError(f"none of {', '.join(using)} is indexed")
        if scope == "all":
            files = self.ledger()
        elif scope == "located":
            files = self.locate_files(df.select(*(F.col(f"`{c}`") for c in keys)))
        else:
            raise ValueError("scope is located or all")
        self._reported(files)
        wanted = self._meta.aliases() if explode == "all" else [a for a in self._meta.aliases() if a in using or a in (self.selected or ())]
        temporal = [c for c in using if c in self._meta.temporal]
        selected = None if self.selected is None else list(dict.fromkeys([*self.selected, *using]))
        rows = read_files(self.spark, self._meta, files, wanted, selected, keep_file=bool(temporal))
        if temporal:
            rows = latest_only(rows, self._meta, self.tables, temporal, {c: df.select(F.col(f"`{c}`").alias("value")) for c in temporal} if how in PROBED else None)
        keep = [c for c in rows.columns if c != reader.FILE and (selected is None or c in selected or c in wanted)]
        rows = rows.select(*(F.col(f"`{c}`") for c in keep))
        return rows.repartition(*(F.col(f"`{c}`") for c in using)) if setting(self.spark, "repartitionDataFiles") else rows

    def join(self, df: DataFrame, using: list[str] | str, how: str = "inner", scope: str = "located", explode: str = "used") -> DataFrame:
        """The index's rows on the left, of located files only unless ``scope`` is all; any USING join."""
        using = [using] if isinstance(using, str) else list(using)
        return self._pruned(df, using, scope, explode, how).join(df, using, how)

    def joined_by(self, df: DataFrame, using: list[str] | str, how: str = "inner", scope: str = "located", explode: str = "used") -> DataFrame:
        """``df`` on the left."""
        using = [using] if isinstance(using, str) else list(using)
        return df.join(self._pruned(df, using, scope, explode, how), using, how)

    def scan(self, equal: dict[str, list] | None = None, between: dict[str, tuple] | None = None, where: str | Column | None = None, latest: bool = True) -> DataFrame:
        """Source columns of the files that can match, with every predicate applied to the rows as well.

        ``equal``: values of a column; ``between``: (low, high), inclusive, None for no bound, pruning on range indexes;
        ``where``: anything else. A scan that nothing prunes reads all files of the ledger. ``latest``: one row for each
        temporal key, as in views.
        """
        files, aliases = None, self._meta.aliases()
        pruning = {c: list(v) for c, v in (equal or {}).items() if c in self.indexes}
        if pruning:
            files = self.locate(pruning, latest)
        for c, (low, high) in (between or {}).items():
            stats = self.tables.stats().read()
            if c in self._meta.range and c in self._meta.built and stats is not None:
                found = locate.within_bounds(stats, c, low, high)
                files = found if files is None else files.join(found, "filename", "left_semi")
        rows = self.rows(self.ledger() if files is None else {r["filename"] for r in files.collect()}, latest)
        for c, v in (equal or {}).items():
            if c in aliases:  # rows with an element that has one of the values
                x = next(x for x in self._meta.exploded if x["as_column"] == c)
                rows = rows.where(F.arrays_overlap(F.col(f"{x['array_column']}.{x['field_path']}"), F.array(*map(F.lit, v))) if v else F.lit(False))
            else:
                rows = rows.where(F.col(f"`{c}`").isin(*v)) if v else rows.where(F.lit(False))
        for c, (low, high) in (between or {}).items():
            rows = rows if low is None else rows.where(F.col(f"`{c}`") >= F.lit(low))
            rows = rows if high is None else rows.where(F.col(f"`{c}`") <= F.lit(high))
        if where is not None:
            rows = rows.where(where)
        return rows.select(*(F.col(f"`{c}`") for c in (self.selected or self.schema.names)))

    def state(self) -> tuple:
        """Changes whenever the ledger, what is indexed, or the definition does."""
        return self.file_list.table.state(), self.tables.stats().state(), self._meta.dump()

    def ledger(self) -> set[str]:
        """The names of all files, indexed or not."""
        return {r["filename"] for r in self.file_list.files.select("filename").collect()}

    def rows(self, files: Iterable[str], latest: bool = True) -> DataFrame:
        """The files' rows with computed columns; with ``latest`` one for each temporal key."""
        names = self._reported(set(files))
        temporal = list(self._meta.temporal) if latest else []
        rows = read_files(self.spark, self._meta, names, keep_file=bool(temporal), mark=self.name)
        return latest_only(rows, self._meta, self.tables, temporal).drop(reader.FILE) if temporal else rows

    def stats(self) -> DataFrame:
        """Distinct values per file of each valued column: FileCount, MinValues, MaxValues, AvgValues, MedianValues, StdDev."""
        table = self.tables.stats().read()
        columns = self._meta.valued()
        if table is None or not columns:
            return self.spark.createDataFrame([], T.StructType([]))
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("Column"), F.coalesce(F.col(f"`nd_{c}`"), F.lit(0)).alias("n")) for c in columns if f"nd_{c}" in table.columns)))
        rows = table.select("filename", pairs.alias("x")).select("filename", "x.*")
        tenth = lambda x: F.round(x, 1).cast("decimal(10,1)")
        return rows.groupBy("Column").agg(
            F.count("filename").alias("FileCount"), F.min("n").cast("int").alias("MinValues"), F.max("n").cast("int").alias("MaxValues"),
            tenth(F.avg("n")).alias("AvgValues"), F.percentile_approx("n", 0.5).cast("int").alias("MedianValues"), tenth(F.stddev("n")).alias("StdDev"),
        )

    def print_index(self, truncate: bool = False) -> None:
        table = self.tables.stats().read()
        if table is not None:
            table.show(truncate=truncate)
            table.printSchema()

    def print_metadata(self) -> None:
        print(self._meta.dump())

    # --- by name ----------------------------------------------------------------------------------------------------

    @staticmethod
    def file_list_name(name: str) -> str:
        return file_list_name(name)

    @staticmethod
    def exists(spark: SparkSession, name: str) -> bool:
        return Files(spark).exists(index_path(spark, name)) or FileList.exists(spark, file_list_name(name))

    @staticmethod
    def remove(spark: SparkSession, name: str) -> bool:
        if not FileIndex.exists(spark, name):
            raise IndexNotFoundException(name)
        Files(spark).delete(index_path(spark, name))
        try:
            FileList.remove(spark, file_list_name(name))
        except FileListNotFoundException:
            pass
        return True


def join_index(df: DataFrame, index: FileIndex, using: list[str] | str, how: str = "inner", **more) -> DataFrame:
    """``df`` joined with an index, ``df`` on the left."""
    return index.joined_by(df, using, how, **more)
