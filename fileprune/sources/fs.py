"""Hadoop file systems from the driver, so that every store Spark reads will do."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_LOCAL = re.compile("^file:/+")


def canonical(uri: str) -> str:
    """The one spelling of a file's URI that the index knows it by."""
    return _LOCAL.sub("file:///", uri)


def canonical_column(uri: Column) -> Column:
    """``canonical`` of each row; the expression is only tried on names that aren't canonical yet."""
    done = ~uri.startswith("file:/") | uri.startswith("file:///") & ~uri.startswith("file:////")
    return F.when(done, uri).otherwise(F.regexp_replace(uri, "^file:/+", "file:///"))


def readable(uri: str) -> str:
    """A canonical URI as the readers take it: without percent encoding."""
    return unquote(uri)


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> None:
        """Write a file; without ``overwrite`` it is an error if there is one."""
        fs, p = self._of(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
            stream.hflush()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside the file, then put it in its place."""
        fs, p = self._of(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        self.create(f"{path}.new", text, overwrite=True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), options)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._of(path)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def modified(self, path: str) -> int:
        fs, p = self._of(path)
        return fs.getFileStatus(p).getModificationTime()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no folder."""
        fs, p = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def expanded(self, path: str) -> list[tuple[str, int]]:
        """(canonical URI, size) of the files that a path, folder or pattern names; a missing path stands for itself with size 0."""
        fs, p = self._of(path)
        found, todo = [], [s for s in (fs.globStatus(p) or [])]
        if not todo and fs.exists(p):  # a name with pattern characters
            todo = [fs.getFileStatus(p)]
        while todo:
            status = todo.pop()
            if status.isDirectory():
                todo += [s for s in fs.listStatus(status.getPath()) if not self._hidden(s.getPath().getName())]
            else:
                found.append((canonical(self._encoded(status.getPath())), status.getLen()))
        return sorted(found) or [(canonical(self._encoded(fs.makeQualified(p))), 0)]

    @staticmethod
    def _hidden(name: str) -> bool:
        """As Spark has it: partition folders may begin with an underscore."""
        return name.startswith(".") or name.startswith("_") and "=" not in name

    def _encoded(self, path) -> str:
        uri = path.toUri()
        scheme, authority = uri.getScheme(), uri.getRawAuthority()
        return f"{scheme}://{authority or ''}{uri.getRawPath()}" if scheme else uri.getRawPath()
