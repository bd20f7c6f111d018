"""Reversible line dedup: sharded cuckoo filters backed by an exact reference-count table.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased; keys of at least 10 code
points count. The exact table has one row for each key and document with its reference count and the line places.
Keys found in two documents or more are droppable; a cuckoo filter for each shard of keys holds them, so most lines
are passed over without asking the exact table, and what the filter lets through is verified there. Inserting
documents adds their references and the keys that become droppable; deleting documents takes both away again, and
a line whose first document goes comes back in the next one.

Keys are 128-bit hashes. There are as many shards as the number of references asks for, and the references of a shard
are dealt by document over as many groups as their counted number needs to meet the filter; those of one key are dealt
likewise to meet the exact keys. So a line that a third of all documents holds is spread. Keys reach the filters once.

Edge cases: a null or empty text is one empty line, which is too short to drop; several equal lines of one document
count as one document and stay or go together; rows of equal id are told apart by their text and never drop lines
of each other; null ids count as the largest; ids must be whole numbers, others raise a TypeError; empty tables give
empty results; of the caller's other columns none is read, and ``clean`` keeps them whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm import cuckoo
from harrier.llm.store import col, fresh, hot_join, long_ids, partitions, salted, written

MIN_CHARS = 10
#: References of a shard, about, and those of a shard that is dealt over groups, at least.
SHARD_ROWS, GROUP_ROWS = 100_000, 4_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1


@dataclass
class LineIndex:
    """references: k1, k2, id, version (of the text), places; keys: droppable k1, k2 with first (the least id)
    and held (references);
    filters: shard, buckets, slots."""

    references: DataFrame
    keys: DataFrame
    filters: DataFrame
    shards: int


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def shard_of(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return docs.select(F.coalesce(long_ids(docs, id_col), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("version"), split_lines(text).alias("lines"))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The exact table of some documents: its reference count is size(places)."""
    lines = _rows(docs, id_col, text_col).select("id", "version", F.posexplode("lines").alias("place", "line"))
    keyed = lines.select("id", "version", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("2"), "key").alias("k2"), "id", "version", "place")
    return hashed.groupBy("k1", "k2", "id", "version").agg(F.collect_set("place").alias("places"))


def droppable(refs: DataFrame) -> DataFrame:
    """Keys held by two documents or more, with the least id: one row for each, combined before any shuffle."""
    return refs.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("held")).filter("first < last").select("k1", "k2", "first", "held")


FILTERS = "shard int, buckets int, slots binary"


def _filter_row(shard: int, table: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([len(table)], pa.int32()), "slots": pa.array([table.tobytes()], pa.binary())})


def _load(buckets: int, slots: bytes) -> np.ndarray:
    return np.frombuffer(slots, np.uint16).reshape(buckets, cuckoo.SLOTS)


def build_filters(keys: DataFrame) -> DataFrame:
    """keys: k1, shard, without repeats."""

    def run(table: pa.Table) -> pa.Table:
        return _filter_row(table.column("shard")[0].as_py(), cuckoo.build(table.column("k1").to_numpy().view(np.uint64)))

    return keys.select("k1", "shard").groupBy("shard").applyInArrow(run, FILTERS)


def build(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    refs = written(references(docs, id_col, text_col, min_chars), "line-references")
    shards = shards or max(partitions(docs.sparkSession), refs.count() // SHARD_ROWS)
    keys = written(droppable(refs), "line-keys")
    return LineIndex(refs, keys, written(build_filters(keys.withColumn("shard", shard_of(shards))), "line-filters"), shards)


def _moved(index: LineIndex, after: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with the references ``after``; touched: keys (k1, k2) whose documents changed."""
    touched = written(touched.select("k1", "k2").distinct(), "line-touched")
    was = index.keys.join(touched, ["k1", "k2"], "left_semi")
    now = written(droppable(after.join(touched, ["k1", "k2"], "left_semi")), "line-keys")
    keys = written(index.keys.join(touched, ["k1", "k2"], "left_anti").unionByName(now), "line-keys")
    gone = was.join(now, ["k1", "k2"], "left_anti").withColumn("add", F.lit(False))
    come = now.join(was, ["k1", "k2"], "left_anti").withColumn("add", F.lit(True))
    change = gone.unionByName(come).select("k1", shard_of(index.shards).alias("shard"), "add")

    def run(key: tuple, held: pa.Table, change: pa.Table) -> pa.Table:
        table = _load(held.column("buckets")[0].as_py(), held.column("slots")[0].as_py()) if held.num_rows else cuckoo.empty(change.num_rows)
        add = np.array(change.column("add").to_pylist(), bool)
        own = change.column("k1").to_numpy().view(np.uint64)
        try:
            return _filter_row(key[0].as_py(), cuckoo.insert(cuckoo.delete(table, own[~add]), own[add]))
        except cuckoo.Full:
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "buckets": pa.array([-1], pa.int32()), "slots": pa.array([b""], pa.binary())})

    filters = written(index.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(run, FILTERS), "line-filters")
    full = filters.filter("buckets < 0").select("shard")
    fresh = build_filters(keys.withColumn("shard", shard_of(index.shards)).join(full, "shard", "left_semi"))
    return LineIndex(after, keys, written(filters.filter("buckets >= 0").unionByName(fresh), "line-filters"), index.shards)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with more documents; documents it holds already (equal id and text) are left as they are."""
    more = references(docs, id_col, text_col, min_chars).join(index.references.select("id", "version").distinct(), ["id", "version"], "left_anti")
    more = written(more, "line-references")
    return _moved(index, written(index.references.unionByName(more), "line-references"), more)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids."""
    ids = ids.select(long_ids(ids, id_col).alias("id")).distinct()
    gone = index.references.join(ids, "id", "left_semi")
    return _moved(index, written(index.references.join(ids, "id", "left_anti"), "line-references"), gone)


def drops(index: LineIndex) -> DataFrame:
    """id, version and places of the lines that go: a document of smaller id holds their key."""
    sharded = index.references.withColumn("shard", shard_of(index.shards))
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("n"))
    dealt, filters, salt = salted(sharded, index.filters.join(sizes, "shard"), ["shard"], "id", "n", "line-shards", GROUP_ROWS)

    def probe(refs: pa.Table, filters: pa.Table) -> pa.Table:
        refs = refs.select(["k1", "k2", "id", "version", "places"])
        if not filters.num_rows or not refs.num_rows:
            return refs.slice(0, 0)
        table = _load(filters.column("buckets")[0].as_py(), filters.column("slots")[0].as_py())
        return refs.filter(pa.array(cuckoo.contains(table, refs.column("k1").to_numpy().view(np.uint64))))

    maybe = dealt.groupBy("shard", salt).cogroup(filters.groupBy("shard", salt)).applyInArrow(probe, "k1 long, k2 long, id long, version long, places array<int>")
    sure = hot_join(maybe, index.keys, ["k1", "k2"], "id", "held", "line-keys").filter("id > first")
    return sure.groupBy("id", "version").agg(F.flatten(F.collect_list("places")).alias("places"))


def _kept(docs: DataFrame, index: LineIndex, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column, Column]:
    """docs with columns of fresh names, and from these: lines, dropped lines, and the kept text."""
    own_id, own_version, gone_id, gone_version, places, lines = fresh(docs, "own_id", "own_version", "gone_id", "gone_version", "places", "lines")
    text = col(text_col).cast("string")
    own = docs.withColumns({own_id: F.coalesce(long_ids(docs, id_col), F.lit(LAST)), own_version: F.xxhash64(text)})
    gone = drops(index).select(F.col("id").alias(gone_id), F.col("version").alias(gone_version), F.col("places").alias(places))
    joined = own.join(gone, (F.col(own_id) == F.col(gone_id)) & (F.col(own_version) == F.col(gone_version)), "left").withColumn(lines, split_lines(text))
    n, gone_at = F.size(lines), F.col(places)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone_at)
    kept = F.when(gone_at.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col(lines), i + 1)), "\n"))
    return joined, n.cast("long"), F.when(gone_at.isNull(), 0).otherwise(F.size(F.array_distinct(gone_at))).cast("long"), kept


def dedup(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with n_lines, n_dropped and kept_text, which take the place of columns of these names.

    The index must hold the documents.
    """
    joined, n, dropped, kept = _kept(docs, index, id_col, text_col)
    new = {"n_lines": n, "n_dropped": dropped, "kept_text": kept}
    return joined.select(*[col(c) for c in docs.columns if c.lower() not in new], *[c.alias(name) for name, c in new.items()])


def clean(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs without the lines that go: the columns of docs, with text (null stays null) and length_col following."""
    joined, _, dropped, kept = _kept(docs, index, id_col, text_col)
    new = {text_col: F.when(dropped > 0, kept).otherwise(col(text_col)).cast(docs.schema[text_col].dataType)}
    if length_col in docs.columns:
        new[length_col] = F.when(dropped > 0, F.length(kept)).otherwise(col(length_col)).cast(docs.schema[length_col].dataType)
    return joined.select(*[(new[c] if c in new else col(c)).alias(c) for c in docs.columns])
