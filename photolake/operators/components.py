"""Connected components by alternating star contractions (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from photolake.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph given as links between comparable ids.

    Returns ``node, component`` with the smallest id of the component, one row for each node that a
    link names. Self links and repeated links change nothing; links with a null end are left out.
    Each round costs a few shuffles of the links, and the rounds grow with the logarithm of the
    longest path. Every round is cut with a written table, which goes when the next one is there. No
    link reaches the driver.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    # the links are made once, whatever it takes to make them
    given = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    alone = given.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    links, seen = given.where("a <> b"), None
    while True:
        # what tells whether the round changed anything is summed up while its links are written
        told = Observation()
        summed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        before = links if seen else None
        links = materialize(_small_star(_large_star(links)).observe(told, F.count("*").alias("n"), summed.alias("sum")), "stars")
        if before is not None:
            discard(before)
        if told.get == seen:
            break
        seen = told.get
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component")
    return stars.unionAll(roots).unionAll(alone).groupBy("node").agg(F.min("component").alias("component"))
