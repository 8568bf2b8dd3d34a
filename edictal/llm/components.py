"""Connected components by alternating stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictal.session import stage


def settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    met = stars.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return met.filter("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: whole numbers), label being the smallest node reachable.

    Each round hangs the larger neighbours of a node, then the node and its smaller ones, on its smallest neighbour; the number of
    rounds grows with the logarithm of the longest chain; links that are stars about their smallest nodes need none.  Links are kept as
    written tables, and no more than one row comes to the driver.
    Self-links are nodes of their own; an empty table gives an empty result.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    stars = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(stars):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that Spark can split the links of a node with very many of them when they meet its smallest neighbour.
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stage(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        stars = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
