"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's lowest neighbour (or itself if lower)."""
    pairs = _both_ways(edges)
    joined = pairs.join(_lowest(pairs), "a").filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the lowest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    lowest = _lowest(down)
    joined = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.union(lowest.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: numbers, not null); the root is the component's smallest
    node. Self-loops are ignored. Each round is a few joins and a table in the shared folder; a node with very
    many neighbours is split by adaptive execution, as it only meets inner joins and combining aggregates.
    Rounds grow with the logarithm of the longest chain; only one row per round comes to the driver.
    """
    now = cut_lineage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
