"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document gets a shuffle key (an MD5 of its id and a seed, so reruns agree) and a virtual finish time: the
words of its source up to it in that order, divided by the source's target. Each document stands in the queue once
for each time it may be taken. The queue is range-sorted by finish time and cut where its words reach the budget.

Running sums do not put a source into one task: rows are range-partitioned by source and key, summed in each range,
and shifted by the sums of the ranges before. Rows meet their source's target dealt by how many there are. So a source
with a third of all rows is spread like any other. Nothing that grows with the rows is broadcast or sent to the driver.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last; sources
of size 0 have target 0; ties of the shuffle key are broken by id and text; repeated rows are mixed one by one; an
empty table gives an empty result. Only the key, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.llm.store import col, hot_join, partitions, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"


def running_sum(rows: DataFrame, group: str, coarse: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of its group up to it.

    order tells rows apart, or ties them alike; coarse are few small columns that never fall in that order, by which
    rows are dealt in ranges.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *coarse).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    parts = dealt.groupBy(group, "range").agg(F.sum(value).alias("held"))
    before = W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(group, "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy(group, "range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dealt.withColumn("within", F.sum(value).over(within))
    return summed.join(parts, [group, "range"]).withColumn(name, F.col("within") + F.col("before")).drop("range", "within", "before")


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """sources with place 0, 1, ... by code point, null last, without sorting all in one task."""
    dealt = sources.orderBy(F.col(by).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "ranked").withColumn("range", F.shiftrightunsigned("at", 33))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return dealt.join(sizes, "range").withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).drop("at", "range", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> tuple[DataFrame, float]:
    """sizes: source, source_size -> with place and target; and the sum of targets.

    Sources share ``share`` of all words by weight (weights repeat along the places), none above ``repeats`` times
    its size; what that cuts off is shared again. Each round is one row of sums for the driver; the level only
    rises and every round but the last caps another source.
    """
    placed = written(ranked(sizes, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(repeats)), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while total:
        at = F.col("weight") * level >= F.col("cap")
        free, fixed, n = placed.agg(F.sum(F.when(~at, F.col("weight"))), F.sum(F.when(at, F.col("cap"))), F.count_if(at)).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - (fixed or 0.0)) / free
    aimed = placed.withColumn("target", F.least(F.col("weight") * F.lit(level), "cap"))
    return aimed, aimed.agg(F.sum("target")).first()[0] or 0.0


def shuffle_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Key, source, size, source_size, target (of its source), taken (words the mix takes of it, repeats counted)."""
    text = col(text_col).cast("string")
    rows = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    # rows that are alike in all of this are interchangeable; the number only tells them apart within this run
    rows = rows.withColumn("key", shuffle_key(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("turn_at", F.conv(F.substring("key", 1, 15), 16, 10).cast("long")).withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    sizes = written(rows.groupBy("of").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source-sizes")
    aimed, budget = targets(sizes, weights, share, repeats)
    placed = hot_join(rows, aimed.select("of", "place", "source_size", "target", "rows"), ["of"], "row", "rows", "targets").drop("of", "rows")
    summed = running_sum(placed, "place", ["turn_at"], ["key", "id", "tie", "row"], "size", "upto")
    turns = summed.filter("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    queue = turns.select("row", "id", "tie", "key", "turn", "place", "size", ((F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target")).alias("finish"), F.lit(0).alias("all"))
    queued = running_sum(queue, "all", ["finish"], ["finish", "place", "key", "id", "tie", "row", "turn"], "size", "spent")
    taken = queued.filter(F.col("spent") <= F.lit(budget) + 0.25).groupBy("row").agg(F.sum("size").alias("taken"))
    out = summed.join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
