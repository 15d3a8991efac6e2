"""Connected components by alternating stars, with every round's links in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (itself included)."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Links lead from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select("u", "v", "m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node that ``links`` (a, b: long) names; a component is its least node.

    Links of a node to itself or with a null end are left out. Only two numbers of each round reach
    the driver. Raises if ``rounds`` were not enough, which takes a chain of about 2^rounds links.
    """
    now = keep(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        now = keep(_small_star(_large_star(now)), "links")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.withColumn("component", F.col("node")))
        state = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
