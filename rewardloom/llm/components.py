"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _check_sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, a and b never null; gives (node, root) with the smallest node reachable, for every node.

    Alternates two steps until the links no longer change: every node hands its larger neighbours to its smallest
    neighbour, then every node hands its smaller neighbours to the smallest of them. The number of links does not
    grow, and rounds grow with the logarithm of the longest chain. Minima are combined on the map side and written
    before they are joined back, so adaptive execution splits a node that most links share. Each round's links are a
    written table, which cuts the lineage. No links: empty result.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _check_sum(edges)
    while before[0]:
        both = _both_ways(edges)
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _check_sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
