"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins; a vertex of high degree is never collected,
and each round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, root) for every node that isn't its own root.

    root is the smallest node of the component. An empty table gives an empty table; loops and
    repeated edges don't matter.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(state)
    while before[0]:
        after = materialize(_small_star(_large_star(state)))
        discard(state)
        state, now = after, _digest(after)
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
