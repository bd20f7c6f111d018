"""Federated search: kinds of things, each filtered, then ranked together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators.ingest import first_filled


def ranked(kinds: list[DataFrame], query: str) -> DataFrame:
    """kinds: kind, id, title, body, updated each -> hits with score, reason, band and excerpt; misses are dropped.

    Order: score, then updated, title, id.
    """
    q = X.search_form(F.lit(query))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    hits = rows.withColumn("score", X.match_score(F.col("title"), F.col("body"), q)).filter("score > 0")
    return hits.select("kind", "id", "title", "updated", "score", X.match_reason(F.col("score")).alias("reason"), X.band(F.col("score")).alias("band"), X.excerpt(F.col("body"), q).alias("excerpt"))


def page(hits: DataFrame, size: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.col("updated").desc_nulls_last(), "title", "id").offset(offset).limit(size)


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count("*").alias("n"))


def normalized(rows: DataFrame, sources: Sequence[str], page: str = "page", index: str = "page_index") -> DataFrame:
    """rows with source, the first of the columns that is neither null nor blank, and page as text.

    A page is a positive number or a name; else it is the index and 1, null without one.
    """
    number, named = F.col(page).try_cast("int"), F.trim(F.col(page))
    kept = (number > 0) | (number.isNull() & (named != ""))
    by_index = (F.col(index).try_cast("long") + 1).cast("string")
    made = rows.withColumn("__source", first_filled(rows, sources)).withColumn("__page", F.when(F.coalesce(kept, F.lit(False)), F.col(page)).otherwise(by_index))
    return made.drop("source", page).withColumnsRenamed({"__source": "source", "__page": page})
