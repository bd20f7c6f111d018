"""Where intermediate tables go, and names that do not clash with the caller's columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.sources.shared import shared_folder, written

__all__ = ["col", "fresh", "hot_join", "long_ids", "map_rows", "new_folder", "partitions", "salted", "shared_folder", "written"]


#: Most keys of a join that are dealt over several groups, and the fewest rows of such a group.
HOT_KEYS, HOT_ROWS = 10_000, 2_000


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the frame has no such column."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(rows: DataFrame, run, width: int | None = None) -> DataFrame:
    """mapInArrow that keeps the first columns of rows under their names, whatever characters these hold."""
    fields = rows.schema.fields[:width]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, schema).toDF(*[f.name for f in fields])


def long_ids(frame: DataFrame, id_col: str) -> Column:
    """The ids as whole numbers; ids of another type raise one clear error before anything runs."""
    kind = frame.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be a column of whole numbers, not {kind.simpleString()}")
    return col(id_col).cast("long")


def salted(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, count: str, name: str, least: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, str]:
    """rows, keyed and the name of a column by which the rows of a key are dealt over groups, in both.

    keyed has one row for each key and how many of the rows hold it in the column ``count``. Keys of more than ``least``
    rows and one in ``HOT_KEYS`` of all rows are dealt over groups of so many, by the hash of the column ``spread``.
    These keys alone are broadcast: there are at most ``HOT_KEYS`` of them, however large the table is.
    """
    keyed = written(keyed, name)
    limit = max(least, (keyed.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS)
    groups, salt = fresh(rows, "groups", "salt")
    filled = F.ceil(F.col(count) / limit).cast("int")
    hot = keyed.filter(F.col(count) > limit).select(*keys, filled.alias(groups))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), groups), F.lit(0)).cast("int")).drop(groups)
    return dealt, keyed.withColumn(salt, F.explode(F.sequence(F.lit(0), filled - 1))), salt


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, count: str, name: str) -> DataFrame:
    """rows joined to keyed (see ``salted``), a key of very many rows in many groups."""
    rows, keyed, salt = salted(rows, keyed, keys, spread, count, name)
    return rows.join(keyed, [*keys, salt]).drop(salt)
