"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links`` (u, v) with the least node reachable from it.

    Alternating stars: every node hands its greater neighbours, then its lesser ones, to its least
    neighbour, until nothing changes; the rounds grow with the logarithm of the longest chain. Least
    neighbours come from an aggregation with a map-side combine and meet the links in a join, so a hub
    with any number of links is split like any other skewed key. Every round is a written table.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        # greater neighbours to the least neighbour (of the node and itself)
        least = materialize(both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both(edges).filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(large.distinct(), "large")
        # lesser neighbours and the node itself to the least of them
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
