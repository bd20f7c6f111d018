"""Places and scales over whole tables and groups, without putting a whole table into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.sources.shared import written


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their place 1, 2, ... in the order: ranges of a sort are numbered and shifted by those before."""
    sorted_rows = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftrightunsigned("__at", 33))
    sizes = sorted_rows.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_rows.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return placed.withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1).drop("__at", "__range", "__before")


def round_robin(rows: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """rows with their place when groups take turns: the first of each group, then the second of each, and so on.

    ``order`` must tell the rows of a group apart. Turns come from ranges of a sort, so a group may hold most rows.
    """
    turns = running(rows, [group], [order], {"__turn": F.lit(1).cast("long")})
    return numbered(turns, ["__turn", group], name).drop("__turn")


def with_extremes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with low_ and high_ of each column over the whole table: one row of extremes is broadcast."""
    return rows.join(F.broadcast(rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])), how="cross")


def min_max(rows: DataFrame, value: str, name: str, larger_is_better: bool = True) -> DataFrame:
    """rows with value scaled to 0 .. 1 over the table; 1 where all are equal."""
    low, high = F.col(f"low_{value}"), F.col(f"high_{value}")
    up = (F.col(value) - low) / (high - low)
    scaled = F.when(high == low, F.lit(1.0)).otherwise(F.round(up if larger_is_better else 1.0 - up, 6))
    return with_extremes(rows, [value]).withColumn(name, scaled).drop(f"low_{value}", f"high_{value}")


def max_scaled(rows: DataFrame, value: str, name: str, counts: Column | None = None) -> DataFrame:
    """rows with value divided by the largest of the rows that count; null for others, and where the largest is 0."""
    counted = F.lit(True) if counts is None else counts
    most = rows.agg(F.max(F.when(counted, F.col(value))).alias("__most"))
    return rows.join(F.broadcast(most), how="cross").withColumn(name, F.when(counted, F.round(F.col(value) / F.nullif("__most", F.lit(0)), 6))).drop("__most")


def keep_last(rows: DataFrame, by: str, order: Sequence[Column], n: int = 10) -> DataFrame:
    """The last n rows of each group in the order given, newest first."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def best_first(score: str, *ties: str) -> list[Column]:
    """The order of scores: largest first, nulls last, ties by the other columns."""
    return [F.col(score).desc_nulls_last(), *[F.col(t) for t in ties]]


def by_name(name: str, *ties: str) -> list[Column]:
    return [F.lower(F.col(name)), *[F.col(t) for t in ties]]


def queue_order(priority: str, available: str, created: str, key: str) -> list[Column]:
    return [F.desc(priority), F.col(available), F.col(created), F.col(key)]


def first_of_source(rows: DataFrame, source: str, order: Sequence[Column], name: str = "new_source") -> DataFrame:
    """rows with 1 on the first row of each source, else 0."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(source).orderBy(*order)) == 1).cast("int"))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: Mapping[str, Column]) -> DataFrame:
    """rows with the sums of values over the rows of their group up to each: ranges of a sort are summed and shifted.

    ``order`` must tell the rows of a group apart. A group of any size is spread over as many tasks as it fills.
    """
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()).select("*", *[v.alias(f"__{n}") for n, v in values.items()]), "running")
    held = dealt.groupBy(*by, "__range").agg(*[F.sum(f"__{n}").alias(f"__sum_{n}") for n in values])
    ahead = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    held = held.select(*by, "__range", *[F.coalesce(F.sum(f"__sum_{n}").over(ahead), F.lit(0)).alias(f"__ahead_{n}") for n in values])
    within = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dealt.select("*", *[F.sum(f"__{n}").over(within).alias(f"__here_{n}") for n in values])
    joined = summed.join(held, [*by, "__range"])
    return joined.select(*rows.columns, *[(F.col(f"__here_{n}") + F.col(f"__ahead_{n}")).alias(n) for n in values])


def running_max(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """rows with the largest value of their group up to each, nulls left out, as ``running`` does it with sums."""
    dealt = written(rows.withColumn("__value", value).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "running")
    ahead = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    held = dealt.groupBy(*by, "__range").agg(F.max("__value").alias("__most")).select(*by, "__range", F.max("__most").over(ahead).alias("__ahead"))
    within = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = dealt.withColumn("__here", F.max("__value").over(within)).join(held, [*by, "__range"])
    return joined.select(*rows.columns, F.greatest("__here", "__ahead").alias(name))


def nearest_ranks(rows: DataFrame, by: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """by and, for each share, the value at index round((n - 1) * share), half to even, of the group's sorted values.

    Values are counted and their places summed by ranges, so no group is collected.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__c"))
    placed = running(counts, [by], [value], {"__upto": F.col("__c")})
    sizes = counts.groupBy(by).agg(F.sum("__c").alias("__n"))
    found = placed.join(sizes, by)
    at = lambda share: F.bround((F.col("__n") - 1) * F.lit(share)).cast("long")
    held = lambda share: (F.col("__upto") - F.col("__c") <= at(share)) & (at(share) < F.col("__upto"))
    return found.groupBy(by).agg(*[F.max(F.when(held(p), F.col(value))).alias(name) for name, p in shares.items()])
