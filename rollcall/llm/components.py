"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    lowest = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(lowest, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(lowest.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that each linked id reaches, itself included.

    `links` holds pairs (a, b) with a < b. Ids without a link have no row. The number of
    rounds grows with the logarithm of the longest path. Sums and minima are combined before
    they move; nothing is collected but two numbers a round.
    """
    now = materialize(links.select("a", "b").where("a < b").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = materialize(_small_star(_large_star(now)), "links")
    heads = now.select(F.col("a").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component_id")).union(heads)
