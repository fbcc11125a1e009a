"""Connected components of a table of links, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours on the smallest node of its neighbourhood.

    The large step moves the neighbours above a node, the small one those below and the node itself. The join
    back to the minimum is an equi-join whose hot nodes the adaptive skew join can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on at most one other, which itself hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    open_nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 OR (up = 1 AND n > 1)")
    return not open_nodes.agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it can reach) of every node with a link; links are columns a, b."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        # The small step's stars are distinct links; those of the large step are as many as the links before.
        edges = written(_star(_star(edges, large=True), large=False).distinct())
        if _settled(edges):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
