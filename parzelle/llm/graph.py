"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.session import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the lowest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("low", F.least("u", "low"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lower neighbours move to the lowest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge, roots included.

    ``edges`` has two columns of node ids, in any direction, repeats and loops
    allowed. The root is the lowest node of the component. The number of rounds grows
    with the logarithm of the longest path; each round is written to the shared
    folder, which cuts the lineage.
    """
    a, b = edges.columns
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u != v").distinct(), "links")
    mark = None
    while True:
        digest = F.xxhash64("u", "v")
        now = current.agg(F.count("*"), F.sum(digest.cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        current = materialize(_small_star(_large_star(current)), "links")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
