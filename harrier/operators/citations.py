"""Citations and excerpts of what an answer rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citations(chunks: DataFrame, by: str, rank: str, parts: list[Column], n: int | None = None) -> DataFrame:
    """by, citation_rank, citation: one for each final chunk, its known parts joined by `` | ``."""
    kept = chunks if n is None else chunks.filter(F.col(rank) <= n)
    return kept.select(by, F.col(rank).alias("citation_rank"), F.concat_ws(" | ", *parts).alias("citation"))


def excerpt(chunks: Column, n: int = 3, most: int = 500) -> Column:
    """The first n of an array of texts, numbered, of each at most so many characters; parted by a blank line."""
    numbered = F.transform(F.slice(chunks, 1, n), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.left(c, F.lit(most))))
    return F.array_join(numbered, "\n\n")
