"""Connected components of an edge table by alternating stars, written to the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds are logarithmic in a component's diameter; a run that needs more is an error, never a partial answer.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge; loops are left out.

    Minima are pre-aggregated before each shuffle and hot nodes meet only in joins that adaptive execution splits.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now)
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = written(_small_star(_large_star(now)), 2 * state[0])
    raise RuntimeError("components did not settle")
