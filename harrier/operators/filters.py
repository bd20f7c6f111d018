"""Predicates and pages: scopes, search filters, shelves of notes, keyset and offset pages, what is left to do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X

#: How many candidates a scoped search asks for.
FLOOR, MOST, PER_PATH = 100, 250, 12
#: Fixed value: tokens of a question that a passage may match.
PASSAGE_TOKENS = 8


def in_folders(path: Column, folders: Sequence[str]) -> Column:
    """The path is one of the folders or lies below one; no folders leave nothing."""
    own = X.normal_path(path)
    tests = [(own == f) | own.startswith(f + "/") for f in (x.replace("\\", "/").strip("/") for x in folders)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search_filter(kind: Column, scope: Column, file_type: Column, updated: Column, *, kinds: Sequence[str] | None = None, scopes: Sequence[str] | None = None, file_types: Sequence[str] | None = None, updated_after: Column | None = None) -> Column:
    """The filters of a federated search; what is None does not restrict, what is empty leaves nothing."""
    out = F.lit(True)
    for column, wanted in ((kind, kinds), (scope, scopes), (F.lower(file_type), None if file_types is None else [t.lower() for t in file_types])):
        if wanted is not None:
            out = out & (column.isin(*wanted) if wanted else F.lit(False))
    return out if updated_after is None else out & (updated > updated_after)


def any_token(question: str, *texts: Column) -> Column:
    """One of the first 8 tokens of the question stands in a text, in any case; null texts are empty."""
    tokens = question.lower().split()[:PASSAGE_TOKENS]
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(t, F.lit(""))).contains(x) for x in tokens for t in texts], F.lit(False))


def holds(term: str, *texts: Column) -> Column:
    """The term stands in one of the texts, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(t).contains(term.lower()), F.lit(False)) for t in texts])


def all_terms(question: str, text: Column) -> Column:
    """Every token of the question is a token of the text."""
    return F.size(F.array_except(X.tokens(F.lit(question)), X.tokens(text))) == 0


def shelf(name: str, trashed: Column, archived: Column, pinned: Column, updated: Column, now: Column, days: int = 30) -> Column:
    """Notes of a list: all, pinned, recent (30 days), archived or trash."""
    here = ~trashed & ~archived
    shelves = {"all": here, "pinned": here & pinned, "recent": here & (updated >= now - F.expr(f"INTERVAL {days} DAYS")), "archived": ~trashed & archived, "trash": trashed}
    if name not in shelves:
        raise ValueError(f"no such list: {name}")
    return shelves[name]


def keyset_page(rows: DataFrame, updated: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next page in (updated, key) order, latest first: limit + 1 rows, of which the last tells that there is more."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast(rows.schema[updated].dataType), F.lit(cursor[1]).cast(rows.schema[key].dataType)
        rows = rows.filter((F.col(updated) < at) | ((F.col(updated) == at) & (F.col(key) < last)))
    return rows.orderBy(F.desc(updated), F.desc(key)).limit(limit + 1)


def offset_page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def low_scores(rows: DataFrame, score: str, threshold: float, limit: int, ties: Sequence[str] = ()) -> DataFrame:
    """The rows below the threshold, lowest first."""
    return rows.filter(F.col(score) < threshold).orderBy(score, *ties).limit(limit)


def reindexed(rows: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly these columns (name, type): those the rows lack are null."""
    return rows.select(*[(F.col(f"`{c}`").cast(kind) if c in rows.columns else F.lit(None).cast(kind)).alias(c) for c, kind in columns])


def pending(asked: DataFrame, attempts: DataFrame, key: str, status: Column) -> DataFrame:
    """What is asked and has no attempt of this status."""
    return asked.join(attempts.filter(status).select(key).distinct(), key, "left_anti")


def run_limit(questions: DataFrame, order: str, mode: str, limits: dict[str, int | None]) -> DataFrame:
    """The questions of a run mode, the first ones in their order; a mode without limit takes all."""
    if mode not in limits:
        raise ValueError(f"no such mode: {mode}")
    return questions if limits[mode] is None else questions.orderBy(order).limit(limits[mode])


def scoped(rows: DataFrame, allowed: DataFrame | None, key: str) -> DataFrame:
    """rows of the allowed keys; None leaves all, an empty table leaves none."""
    return rows if allowed is None else rows.join(allowed.select(key).distinct(), key, "left_semi").select(*rows.columns)


def candidate_depth(paths: int | Column) -> Column:
    """Candidates of a scoped search: 12 for each path, between 100 and 250."""
    return F.least(F.lit(MOST), F.greatest(F.lit(FLOOR), PER_PATH * (F.lit(paths) if isinstance(paths, int) else paths)))


#: Words of a query that ask for recent records, and for records of a type, with their chips.
RECENT = ("recent", "recently", "latest")
TYPES = (("documents", "Documents"), ("passages", "Passages"), ("notes", "Notes"), ("conversations", "Conversations"), ("summaries", "Summaries"))


def chips(query: Column) -> Column:
    """How a query was read: a chip for recency, which may be part of a word, and one for each type it names."""
    low = F.lower(F.coalesce(query, F.lit("")))
    recent = reduce(lambda a, b: a | b, [low.contains(w) for w in RECENT])
    return F.array_compact(F.array(F.when(recent, "Recently updated"), *[F.when(low.rlike(rf"\b{word}\b"), label) for word, label in TYPES]))


def interpretation(chips: Column) -> Column:
    """applied, and an explanation that lists the chips, or null."""
    return F.struct((F.size(chips) > 0).alias("applied"), F.when(F.size(chips) > 0, F.concat(F.lit("Interpreted as "), F.array_join(chips, ", "), F.lit("."))).alias("explanation"))
