"""Trees as tables of (id, parent): closure downwards and upwards, by paths of doubled length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.sources.shared import written


def _links(edges: DataFrame) -> DataFrame:
    """low, high: the edges, each once, without those that lead nowhere."""
    return edges.select(F.col("id").alias("low"), F.col("parent").alias("high")).filter("low is not null and high is not null").distinct()


def _doubled(paths: DataFrame) -> DataFrame:
    """low, high: the ends of two paths, one after the other."""
    upper = paths.select(F.col("low").alias("middle"), F.col("high").alias("top"))
    return paths.join(upper, paths["high"] == upper["middle"]).select("low", F.col("top").alias("high")).distinct()


def closure(seeds: DataFrame, edges: DataFrame, down: bool = True, note: Callable[[int], None] | None = None) -> DataFrame:
    """Column id: the seeds and all below them (or above). edges: id, parent.

    Round k knows the ends of all paths of 2 ** k edges, and what it has found lies fewer than 2 ** k edges away, so the
    rounds are as many as the digits of the depth, whatever the shape: a tree has one such path a node. It stops when
    a round finds nothing, which a cycle does not hinder. An id may have several parents; ``note`` is told each round.
    """
    near, far = ("high", "low") if down else ("low", "high")
    found = written(seeds.select("id").filter("id is not null").distinct(), "closure")
    paths, n, k = written(_links(edges), "paths"), found.count(), 0
    while True:
        next_ = found.unionByName(found.join(paths, found["id"] == paths[near]).select(F.col(far).alias("id"))).distinct()
        next_ = written(next_, "closure")
        more, k = next_.count(), k + 1
        if note is not None:
            note(k)
        if more == n:
            return found
        found, n = next_, more
        paths = written(_doubled(paths), "paths")


def cycles(edges: DataFrame) -> DataFrame:
    """Column id: those that stand on a cycle of the edges, empty for a tree.

    A path longer than there are ids must run through a cycle: its end stands on the cycle or above it, and finding these
    ends takes as many rounds as that number has digits. What stands above a cycle is then peeled off from its top, a
    round for each edge of the longest way up; a table without cycles needs none of these.
    """
    paths = written(_links(edges), "paths")
    n, length = paths.select("low").distinct().count(), 1
    while length <= n and not paths.isEmpty():
        paths, length = written(_doubled(paths), "paths"), 2 * length
    ends = written(paths.select(F.col("high").alias("id")).distinct(), "ends")
    if ends.isEmpty():
        return ends
    # within what the long paths end in, an id of a cycle is above one of its own parents
    own = _links(edges).join(ends.withColumnRenamed("id", "low"), "low", "left_semi").join(ends.withColumnRenamed("id", "high"), "high", "left_semi")
    kept = written(own.select("low", "high"), "cycle-links")
    while True:  # ids that no id of the rest has as a parent, or that have none, are on no cycle
        fewer = kept.join(kept.select(F.col("high").alias("low")).distinct(), "low", "left_semi").join(kept.select(F.col("low").alias("high")).distinct(), "high", "left_semi").select("low", "high")
        fewer = written(fewer, "cycle-links")
        if fewer.count() == kept.count():
            return kept.select(F.col("low").alias("id")).distinct()
        kept = fewer
