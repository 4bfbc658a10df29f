"""The indexes of a storage path: listing, description, and SQL views."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileprune.conf import storage_path
from fileprune.errors import FilePruneError, IndexNotFoundException, StorageMigrationException
from fileprune.index import FileIndex, PruneReport
from fileprune.plans.pruning import needed_files
from fileprune.sources.fs import Files
from fileprune.sources.paths import validated


@dataclass
class _View:
    """A registered view: its index, the state of that when the view was made, its rows, and the files that weren't indexed then."""

    name: str
    state: tuple
    rows: DataFrame
    files: set[str]
    unindexed: set[str]


#: By application and name, the views that were registered.
_views: dict[tuple[str, str], _View] = {}


@dataclass(frozen=True)
class IndexSummary:
    name: str
    format: str
    columns: tuple[str, ...]
    indexes: tuple[str, ...]
    bloom: tuple[str, ...]
    range: tuple[str, ...]
    temporal: tuple[str, ...]
    computed: tuple[str, ...]
    exploded: tuple[str, ...]
    file_count: int
    total_size: int


class IndexCatalog:
    def __init__(self, spark: SparkSession):
        self.spark, self.files = spark, Files(spark)
        self._last: dict[str, tuple[FileIndex, set[str]]] = {}

    def _root(self) -> str:
        return f"{storage_path(self.spark)}/indexes"

    def list(self) -> list[str]:
        return [n for n in self.files.names(self._root()) if self.files.exists(f"{self._root()}/{n}/metadata.json")]

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{self._root()}/{validated(name)}/metadata.json")

    def get(self, name: str) -> FileIndex:
        if not self.exists(name):
            raise IndexNotFoundException(name)
        return FileIndex(self.spark, name)

    def describe(self, name: str) -> IndexSummary:
        index = self.get(name)
        meta = index.metadata
        group = lambda names: tuple(sorted(names))
        return IndexSummary(name, meta.format, tuple(index.schema.names), group(meta.indexes), group(meta.bloom), group(meta.range), group(meta.temporal), group(meta.computed), group(meta.aliases()), index.file_list.files.count(), meta.total_size)

    def describe_all(self) -> list[IndexSummary]:
        """Those that can be read; one whose storage can't be brought up to date is an error."""
        out = []
        for name in self.list():
            try:
                out.append(self.describe(name))
            except StorageMigrationException:
                raise
            except FilePruneError:
                continue
        return out

    def find_indexes(self, path: str) -> list[str]:
        """Names of the indexes whose ledger has that file."""
        return [n for n in self.list() if self.get(n).has_file(path)]

    def to_df(self) -> DataFrame:
        rows = [tuple(",".join(v) if isinstance(v, tuple) else v for v in asdict(s).values()) for s in self.describe_all()]
        return self.spark.createDataFrame(rows, "name string, format string, columns string, indexes string, bloom string, range string, temporal string, computed string, exploded string, file_count long, total_size long")

    def remove(self, name: str) -> bool:
        return FileIndex.remove(self.spark, name)

    def register(self, name: str, view: str | None = None) -> None:
        """The index as a read-only view: source columns of all files of the ledger, latest versions of temporal keys.

        A view is a plain DataFrame, so SQL over it is all of Spark SQL with column pruning and pushed filters. ``sql`` reads
        the ledger anew and prunes; a view that is read otherwise has the files of the time it was registered.
        """
        self._made(self.get(name), view or name).rows.createOrReplaceTempView(view or name)

    def register_all(self, prefix: str = "") -> list[str]:
        for name in self.list():
            self.register(name, prefix + name)
        return [prefix + n for n in self.list()]

    @staticmethod
    def _rows(index: FileIndex, files: set[str]) -> DataFrame:
        return index.rows(files).select(*(F.col(f"`{c}`") for c in index.schema.names))

    def _made(self, index: FileIndex, view: str) -> _View:
        """The view of all files of the ledger, made anew if the index has changed since."""
        key, state = (self.spark.sparkContext.applicationId, view), (index.path, index.state())
        now = _views.get(key)
        if now is None or now.state != state:
            files = index.ledger()
            now = _views[key] = _View(index.name, state, self._rows(index, files), files, index.unindexed_files())
            now.rows.createOrReplaceTempView(view)
        return now

    def sql(self, query: str) -> DataFrame:
        """``query`` over registered views, which follow their ledgers, reading only files that can matter.

        Equalities and IN lists on indexed columns, bounds on range indexes, and equi-joins with anything (inner, semi, or outer
        where the index's unmatched rows are lost) prune; files that aren't indexed yet are read always. All conditions are
        still applied to the rows, so the result is that of the unpruned query. ``report`` says what a view of the last query read.
        """
        application = self.spark.sparkContext.applicationId
        names = {v: x.name for (a, v), x in _views.items() if a == application and re.search(rf"(?i)(?<!\w){re.escape(v)}(?!\w)", query) and self.exists(x.name)}
        indexes = {name: self.get(name) for name in set(names.values())}
        views = {view: self._made(indexes[name], view) for view, name in names.items()}
        needed = {}
        if views:
            key = "spark.sql.optimizer.inSetConversionThreshold"  # lists of literals stay readable in the plan
            before = self.spark.conf.get(key)
            self.spark.conf.set(key, str(1 << 30))
            try:
                needed = needed_files(self.spark, self.spark.sql(query), indexes)
            finally:
                self.spark.conf.set(key, before)
        pruned = {view: needed[now.name] | now.unindexed for view, now in views.items() if now.name in needed}
        try:
            for view, files in pruned.items():
                self._rows(indexes[views[view].name], files).createOrReplaceTempView(view)
            return self.spark.sql(query)
        finally:
            for view, now in views.items():
                self._last[view] = (indexes[now.name], pruned.get(view, now.files))
                if view in pruned:
                    now.rows.createOrReplaceTempView(view)

    def files_read(self, view: str) -> int:
        """How many files the last query of ``sql`` read of a view."""
        return len(self._last[view][1])

    def report(self, view: str) -> PruneReport | None:
        """What the last query of ``sql`` read of a view; counted when it is asked for."""
        index, files = self._last[view]
        return index.report_of(files)
