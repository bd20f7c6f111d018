"""Map-reduce summaries: groups under a budget, combined level by level until one group is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.context import pack
from harrier.sources.shared import written


def summarize(rows: DataFrame, by: str, order: str, size: str, limit: int, shrink: Callable[[Column], Column] = lambda total: F.ceil(total / 4).cast("long"), levels: int = 20) -> DataFrame:
    """by, level, group_index, members, size of every group of every level.

    ``shrink`` gives the size of a group's summary from the sum of its members; a level must be shorter than the one
    before, or an error says so. Groups follow the order; a group holds what fits the limit, or one larger member.
    """
    now = rows.select(by, F.col(order).cast("long").alias("pos"), F.col(size).cast("long").alias("size"))
    out, before = None, None
    for level in range(levels):
        packed = pack(now, [by], ["pos"], "size", limit)
        groups = packed.groupBy(by, F.col("bin").alias("group_index")).agg(F.count("*").alias("members"), F.sum("size").alias("total"))
        done = groups.select(by, F.lit(level).alias("level"), "group_index", "members", shrink(F.col("total")).alias("size"))
        done = written(done, "summary-level")
        out = done if out is None else out.unionByName(done)
        most = done.groupBy(by).count().agg(F.max("count"), F.sum("count")).first()
        if most[0] is None or most[0] <= 1:
            return out
        if before is not None and most[1] >= before:
            raise ValueError("a level did not get shorter")
        before = most[1]
        now = done.select(by, F.col("group_index").cast("long").alias("pos"), "size")
    raise ValueError("too many levels")
