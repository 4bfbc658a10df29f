"""File-pruned analytics on Spark: a file-level index and joins that read only the files that can match."""

from fileprune.index import FileIndex, PruneReport, join_index
from fileprune.plans.catalog import IndexCatalog, IndexSummary
from fileprune.sources.filelist import FileList

__all__ = ["FileIndex", "FileList", "IndexCatalog", "IndexSummary", "PruneReport", "join_index"]
