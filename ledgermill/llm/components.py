"""Connected components of a link table, by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.session import materialise


def _distinct(a, b, rows: DataFrame) -> DataFrame:
    return rows.select(a.alias("a"), b.alias("b")).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is the least node reachable.

    `links` has (a, b) in any direction; links of a node with itself and repeats are ignored. Each round moves all neighbours
    of a node to its least neighbour, first the larger, then the smaller ones; only minima are aggregated, so a node with
    any number of links is never collected. Rounds grow with the logarithm of the longest path. Each ends in a checkpoint.
    """
    edges = materialise(_distinct(F.greatest("a", "b"), F.least("a", "b"), links))
    state = None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(new) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = tuple(new)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(F.col("b"), F.col("m"), both.join(least, "a").where("b > a"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b > m").select("b", "m").unionByName(lower.select(F.col("a").alias("b"), "m"))
        edges = materialise(_distinct(F.col("b"), F.col("m"), small))
