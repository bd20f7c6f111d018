"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm.store import written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. Edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) with v < u -> (u, v): each node that is not the least of its component, and that least node.

    Each round is a few joins and aggregations whose rows are at most the edges; two numbers reach the driver, to
    see whether a round changed anything. An empty table of edges has no components.
    """
    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())

    now = written(edges.select("u", "v").filter("v < u").distinct(), "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            return now
        now = written(_small(_large(now)), "edges")
        after = state(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
