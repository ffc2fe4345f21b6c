"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """Rows `(node, root)` for each node of `links (a, b)`: root is its component's smallest.

    Large-star and small-star steps in turn: the first moves the larger neighbours of a node
    to its smallest one, the second the smaller ones, until every node hangs on its root. The
    rounds grow with the logarithm of the longest path. Each round is a stored table, so no
    lineage builds up; only a count and a checksum come to the driver. Nothing is gathered
    per node: minima combine before the shuffle, and a join with a hub's rows is split by
    adaptive execution. Links of a node to itself and repeated links change nothing; nulls
    are no nodes.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, "a").where("b > a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), "m")
    return moved.unionByName(least).select("a", F.col("m").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
