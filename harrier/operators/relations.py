"""Joins of records: notes and their index, sessions, links, versions, citations, pairs, frontiers and grids."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.operators.ranking import running_max
from harrier.sources.shared import plain_unions, written

#: Fixed value: the order of roles within a turn.
ROLES = ("system", "user", "assistant")


def indexed_notes(notes: DataFrame, states: DataFrame, key: str = "note_id") -> DataFrame:
    """Notes whose index holds their current revision: states has key, state and revision."""
    ready = states.filter(F.col("state") == "indexed").select(F.col(key).alias("__key"), F.col("revision").alias("__revision"))
    return notes.join(ready, (F.col(key) == F.col("__key")) & (F.col("revision") == F.col("__revision")), "left_semi")


def session_messages(messages: DataFrame, sessions: DataFrame, session: str, user: str, who: Column, turn: str = "turn", role: str = "role") -> DataFrame:
    """The messages of a user's sessions with seq, their place: by turn, then role."""
    mine = messages.join(sessions.filter(F.col(user) == who).select(session).distinct(), session, "left_semi")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role)), F.lit(0)), F.lit(len(ROLES) + 1))
    return mine.withColumn("seq", F.row_number().over(W.partitionBy(session).orderBy(turn, place)))


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str = "children") -> DataFrame:
    """parents with how many children each has, 0 for none. Children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias("__parent")).agg(F.count("*").alias("__n"))
    return parents.join(counts, F.col(parent_key) == F.col("__parent"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__parent", "__n")


def through(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, link_left: str, link_right: str, right_key: str) -> DataFrame:
    """left and right rows that a link joins, each pair once."""
    pairs = links.select(F.col(link_left).alias("__l"), F.col(link_right).alias("__r")).distinct()
    return left.join(pairs, F.col(left_key) == F.col("__l")).join(right, F.col("__r") == F.col(right_key)).drop("__l", "__r")


def lookup(rows: DataFrame, names: DataFrame, key: str, their_key: str, name: str, alias: str, default: str | None = None) -> DataFrame:
    """rows with the name of their key, or the default."""
    small = names.select(F.col(their_key).alias("__key"), F.col(name).alias("__name"))
    return rows.join(small, F.col(key) == F.col("__key"), "left").withColumn(alias, F.coalesce("__name", F.lit(default))).drop("__key", "__name")


def published(rows: DataFrame, identities: Sequence[tuple[DataFrame, Sequence[str]]], paths: DataFrame | None, path: str, key: str) -> DataFrame:
    """Rows that any table of identities names (with its own key columns), within the paths; None leaves all paths."""
    found = [rows.join(names.select(*keys).distinct(), list(keys), "left_semi").select(key) for names, keys in identities]
    kept = rows.join(reduce(DataFrame.union, found).distinct(), key, "left_semi")
    return kept if paths is None else kept.join(paths.select(path).distinct(), path, "left_semi").select(*rows.columns)


def reused_vectors(chunks: DataFrame, held: DataFrame, keys: Sequence[str], created: str, vector: str) -> DataFrame:
    """chunks with the vector that is held for their keys, the newest one, or null."""
    newest = held.groupBy(*keys).agg(F.max_by(vector, created).alias(vector))
    return chunks.join(newest, list(keys), "left")


def upload_duplicates(uploads: DataFrame, accessible: DataFrame, digest: str) -> DataFrame:
    """The uploads whose digest an accessible document has."""
    return uploads.join(accessible.select(digest).distinct(), digest, "left_semi")


def active_jobs(jobs: DataFrame, active: Column, version: str, document: str, digest: str, key: str) -> DataFrame:
    """The first active job of each version, or of each document and digest where no version is known."""
    same = F.when(F.col(version).isNotNull(), F.concat(F.lit("v:"), F.col(version).cast("string"))).otherwise(F.concat_ws(":", F.lit("d"), F.col(document).cast("string"), F.col(digest)))
    first = jobs.filter(active).withColumn("__n", F.row_number().over(W.partitionBy(same).orderBy(key)))
    return first.filter("__n = 1").drop("__n")


def joined_questions(benchmark: DataFrame, results: DataFrame, question: str) -> DataFrame:
    """Benchmark rows and results of the same question, but for case and white space; the rows' own columns win."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    theirs = results.withColumn("__q", norm(F.col(question))).drop(*[c for c in results.columns if c in benchmark.columns])
    return benchmark.withColumn("__q", norm(F.col(question))).join(theirs, "__q").drop("__q")


def matched_citations(citations: DataFrame, records: DataFrame, key: str = "citation_id") -> DataFrame:
    """citations (key, chunk_id, source, page) with matched: the record of its chunk, else the first of source and page."""
    ids = records.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("record_id").alias("by_chunk"))
    pages = records.groupBy("source", "page").agg(F.min("record_id").alias("by_page"))
    found = citations.join(ids, "chunk_id", "left").join(pages.withColumnsRenamed({"source": "__s", "page": "__p"}), F.col("source").eqNullSafe(F.col("__s")) & F.col("page").eqNullSafe(F.col("__p")), "left")
    return found.select(*[F.col(c) for c in citations.columns], F.coalesce("by_chunk", "by_page").alias("matched"))


def pairs(rows: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """by, lo, hi, delta: every two rows of a group, the smaller key first, and the difference of their values."""
    a, b = (rows.select(*by, F.col(key).alias(k), F.col(value).alias(v)) for k, v in (("lo", "a"), ("hi", "b")))
    return a.join(b, list(by)).filter("lo < hi").select(*by, "lo", "hi", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


#: Different values of all criteria that one task may hold.
FRONTIER = 50_000


def _staircase(x: np.ndarray) -> np.ndarray:
    """Which rows of three criteria (larger is better), sorted downwards by all of them, no other row beats.

    Rows come by falling first criterion; the best of the others so far are a staircase: rising second, falling third.
    """
    ups: list[float] = []
    tops: list[float] = []
    keep = np.zeros(len(x), bool)
    for k, (y, z) in enumerate(x[:, 1:].tolist()):
        at = bisect.bisect_left(ups, y)
        if at < len(ups) and tops[at] >= z:
            continue
        keep[k] = True
        first = at
        while first and tops[first - 1] <= z:
            first -= 1
        last = at + 1 if at < len(ups) and ups[at] == y else at
        ups[first:last], tops[first:last] = [y], [z]
    return keep


def _unbeaten(rows: DataFrame) -> DataFrame:
    """Rows (__a, __b, __c, all different) that no other row of their partition beats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            own = pd.concat(held).sort_values(["__a", "__b", "__c"], ascending=False)
            yield own[_staircase(own[["__a", "__b", "__c"]].to_numpy(float))]

    return rows.mapInPandas(run, rows.schema)


def pareto(rows: DataFrame, most: Sequence[str], least: Sequence[str], few: int = FRONTIER) -> DataFrame:
    """The rows that no other row beats: as good in all columns and better in one. Rows with nulls take no part.

    For one to three columns of numbers. Values are compared once, however many rows have them. Each task drops what its
    own rows beat, which is nearly all. What is left is dealt in ranges of a sort by all columns; ranges meet pairwise as
    in a merge tree. All rows of the earlier side of a pair are as good in the first column, so a row of the later side
    is beaten if the best third value among those of the earlier side that are as good in the second is as good as its
    own: a running maximum along a sort. So no step costs more than a sort, also where no row is beaten at all.
    """
    if not 1 <= len(most) + len(least) <= 3:
        raise ValueError("a frontier takes one to three columns")
    whole = rows.dropna(subset=[*most, *least])
    scores = [F.col(c).cast("double") for c in most] + [-F.col(c).cast("double") for c in least]
    scores = [*scores, *[F.lit(0.0)] * (3 - len(scores))]
    named = {n: c + 0.0 for n, c in zip(("__a", "__b", "__c"), scores, strict=True)}  # 0.0 and -0.0 are one value
    left = written(_unbeaten(whole.select(*[c.alias(n) for n, c in named.items()]).distinct()), "frontier")
    if left.count() <= few:
        left = _unbeaten(left.coalesce(1))
    else:
        order = [F.col(c).desc() for c in named]
        dealt = left.repartitionByRange(*order).withColumn("__r", F.spark_partition_id())
        parts, size = (dealt.agg(F.max("__r")).first()[0] or 0) + 1, 1
        left = written(_unbeaten(dealt), "frontier")
        while size < parts:
            later = F.pmod(F.floor(F.col("__r") / size), F.lit(2)).cast("int")
            paired = left.withColumn("__pair", F.floor(F.col("__r") / (2 * size))).withColumn("__later", later)
            seen = running_max(paired, ["__pair"], [F.col("__b").desc(), "__later", F.col("__c").desc(), F.col("__a").desc()], F.when(F.col("__later") == 0, F.col("__c")), "__best")
            beaten = (F.col("__later") == 1) & F.coalesce(F.col("__best") >= F.col("__c"), F.lit(False))
            left, size = written(seen.filter(~beaten).select(*left.columns), "frontier"), 2 * size
    return whole.withColumns(named).join(left.select(*named), list(named), "left_semi").select(*rows.columns)


def parent_links(rows: DataFrame, parents: DataFrame, key: str, their_key: str, name: str) -> DataFrame:
    """rows with parent, the name of the row they hang below, null for a root."""
    return lookup(rows, parents, key, their_key, name, "parent")


def grid(spark: SparkSession, parameters: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the parameters, numbered in their order, with a fingerprint of its settings."""
    rows = [(f"experiment_{i:03d}", fingerprint(dict(zip(parameters, values, strict=True))), *values) for i, values in enumerate(itertools.product(*parameters.values()), 1)]
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame(rows, "experiment_id string, fingerprint string, " + ", ".join(f"`{k}` {kinds[type(v[0])]}" for k, v in parameters.items()))


def fingerprint(settings: Mapping) -> str:
    """12 hex digits of the settings as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(dict(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def row_fingerprint(columns: Sequence[str]) -> Column:
    """The fingerprint of each row's columns, as ``fingerprint`` makes it of one setting."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), F.lit(12))


def hydrated(rows: DataFrame, documents: DataFrame, versions: DataFrame, path: str, document: str, version: str) -> DataFrame:
    """rows with the document of their path and the fields of its current version; nulls where there is none."""
    return rows.join(documents, path, "left").join(versions, [document, version], "left")


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of unlike kinds as one table; columns that a kind lacks are null."""
    plain_unions(frames[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def one_root_each(roots: Sequence[DataFrame], path: str) -> DataFrame:
    """The rows of all roots; a path that two rows have is an error."""
    every = stacked(roots)
    twice = every.groupBy(path).agg(F.count("*").alias("n")).filter("n > 1").orderBy(path).limit(5).collect()
    if twice:
        raise ValueError(f"paths that stand twice: {', '.join(str(r[0]) for r in twice)}")
    return every


def repeated_paths(roots: Sequence[DataFrame], path: str) -> DataFrame:
    """Paths that two rows or more have, with their number."""
    return stacked(roots).groupBy(path).agg(F.count("*").alias("n")).filter("n > 1")


def keys_of(how: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """The keys (one column) of both, of the left alone, or of either, each once."""
    return {"both": left.intersect, "left": left.subtract, "either": lambda r: left.union(r).distinct()}[how](right)
