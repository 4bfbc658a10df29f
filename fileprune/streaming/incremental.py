"""Keeping an index up to date from a stream of file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fileprune.index import FileIndex


def index_stream(index: FileIndex, paths: DataFrame, column: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch's file names are added and indexed. A batch that is repeated after a failure changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        names = [r[0] for r in batch.select(column).distinct().collect()]  # a batch's files, whose scan is planned here
        if names:
            index.add_file(*names)
            index.update()

    writer = paths.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
