"""Connected components of an edge table by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b), both long: label is the smallest node that is reachable.

    Each round is written to the shared folder; nothing but two numbers a round comes to the driver. A node with very
    many neighbours is a grouped minimum (combined before the shuffle) and one side of a join that Spark can split.
    An empty table gives an empty table; loops and repeated edges do no harm.
    """
    links = written(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star"
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        spent = links
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        removed(spent, large)
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select("v", "v").distinct())
