"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _stars(edges: DataFrame, *, small: bool) -> DataFrame:
    """One round over edges (a > b). Large: each node's larger neighbours go to its least one; small: the others, and itself."""
    if small:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    else:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = near.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("node", "low"))
    if small:
        out = near.join(least, "node").select(F.col("other").alias("x"), "low").union(least.select(F.col("node").alias("x"), "low"))
    else:
        out = near.join(least, "node").where(F.col("other") > F.col("node")).select(F.col("other").alias("x"), "low")
    return out.where(F.col("x") != F.col("low")).select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()


def connected_components(links: DataFrame, *, rounds: int = 50) -> DataFrame:
    """links: a, b (long). A row (node, component) for each linked node; component is the least node reachable.

    Each round is written to the shared folder, so that lineage stays short; only counts and sums reach the driver.
    """
    spark = links.sparkSession
    edges = staged(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        large = staged(spark, _stars(edges, small=False), "stars")
        small = staged(spark, _stars(large, small=True), "stars")
        state = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_staged(spark, edges)
        drop_staged(spark, large)
        edges = small
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = state
    raise RuntimeError(f"components haven't settled in {rounds} rounds")
