"""Row-level authorization as predicates and semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a permission implies those before it.
ORDER = ("view", "comment", "edit", "manage")


def implied_by(action: str) -> tuple[str, ...]:
    """Permissions that allow an action; an unknown action needs view itself."""
    action = action.strip().lower()
    if action == "delete":
        return ("delete", "manage")
    return ORDER[ORDER.index(action) :] if action in ORDER else ("view",)


def live(deleted_at: Column, lifecycle: Column, indexing: Column) -> Column:
    """Not deleted, where unknown states count as live."""
    return deleted_at.isNull() & (lifecycle.isNull() | (lifecycle != "deleted")) & (indexing.isNull() | (indexing != "deleted"))


def unexpired(expires_at: Column, as_of: Column) -> Column:
    return expires_at.isNull() | (expires_at > as_of)


def granted(rows: DataFrame, grants: list[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """Keys of rows that any grant reaches: (grants, column in rows, column in grants) each.

    The grants' keys are joined one by one and united before the rows are looked up, so no OR of EXISTS is planned.
    """
    found = [rows.join(g.select(F.col(theirs).alias("__g")).distinct(), rows[ours] == F.col("__g"), "left_semi").select(key) for g, ours, theirs in grants]
    return reduce(DataFrame.union, found).distinct()


def visible(rows: DataFrame, key: str, base: Column, scopes: list[Column], allowed: DataFrame, paths: DataFrame | None = None, path: str = "path", authenticated: bool = True) -> DataFrame:
    """Rows that pass base and any scope, or base and a grant. paths: None leaves all; an empty table leaves none."""
    if not authenticated:
        return rows.limit(0)
    mine = reduce(lambda a, b: a | b, scopes, F.lit(False))
    flagged = rows.filter(base).join(allowed.select(F.col(key).alias("__k"), F.lit(True).alias("__acl")).distinct(), F.col(key) == F.col("__k"), "left")
    out = flagged.filter(F.coalesce(mine, F.lit(False)) | F.coalesce("__acl", F.lit(False))).drop("__k", "__acl")
    return out if paths is None else out.join(paths.select(path).distinct(), path, "left_semi").select(*rows.columns)


def allowed_by(action: Column) -> Column:
    """``implied_by`` of each row's action."""
    low, out = F.lower(F.trim(action)), None
    for name in ("delete", *ORDER):
        case = F.array(*[F.lit(p) for p in implied_by(name)])
        out = F.when(low == name, case) if out is None else out.when(low == name, case)
    return out.otherwise(F.array(*[F.lit(p) for p in implied_by("")]))
