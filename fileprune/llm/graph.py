"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm.common import Scratch


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours.

    The least neighbours are written first: then both sides of the join are plain exchanges, and the neighbours of a hub,
    which are most of the links of a large component, can be dealt to several tasks.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("root").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them. Links go from the greater node to the lesser."""
    least = links.groupBy("u").agg(F.min("v").alias("root"))
    lesser = links.join(least, "u").where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v"))
    return lesser.union(least.select("u", F.col("root").alias("v")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not the least of its component, root being the least.

    Large and small stars take turns until the table no longer changes, in a number of rounds that grows with the
    logarithm of the links; each round is written to the shared folder (that of ``scratch``, which the caller clears) and the one
    before it deleted. Self-links and repeated links do no harm.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    now = scratch.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after = scratch.written(_small_star(_large_star(now, scratch).distinct()).distinct(), "links")
        after_mark = _mark(after)
        scratch.drop(now)
        now, changed, mark = after, after_mark != mark, after_mark
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
