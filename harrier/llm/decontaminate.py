"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, then verified hits.

Normalising lower-cases A-Z; words are runs of [0-9a-z] and of characters from U+0080 on. Every run of ``n``
words of a test item is a window; an item of fewer words, but at least one, is one window of all its words.
Tasks hash all word windows of the training texts, look them up in the set, compare the words of each hit with
those of the test window, and mark the words that lie in any occurrence.

The set is broadcast in parts of at most ``max_windows`` windows, one after another: the driver and each task hold one
part at a time. One part is the usual case and takes one pass over the texts. With more, each part's pass writes the
hits it finds by hash of the text, the next part follows, and a last pass joins the hits to the texts.

Edge cases: a null or empty text has no words and is never contaminated; a null, empty or wordless test item has
no windows; equal items all count as found; repeated rows are judged one by one; an empty table of items marks
nothing, an empty table of texts gives an empty result; other columns are kept by ``clean_documents`` whatever their
names, and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import textops as T
from harrier.llm.store import col, fresh, map_rows, written

N = 10
#: Test windows of a part: about 120 bytes each, so 60 MB.
MAX_WINDOWS = 500_000


@dataclass
class TestSet:
    """Windows of test items. keys[n] are sorted hashes of those of n words, spelled[n] their words joined by spaces,
    and items[n] the items that hold each."""

    keys: dict[int, np.ndarray]
    spelled: dict[int, list[bytes]]
    items: dict[int, list[tuple]]
    seen: dict[int, np.ndarray] = field(default_factory=dict)

    def maybe(self, size: int, windows: np.ndarray) -> np.ndarray:
        """Places of windows that may be in the set, by a bitmap of 22 bits of the hashes."""
        if size not in self.seen:
            self.seen[size] = np.zeros(1 << 22, bool)
            self.seen[size][(self.keys[size] >> np.uint64(42)).astype(np.int64)] = True
        return np.flatnonzero(self.seen[size][(windows >> np.uint64(42)).astype(np.int64)])


def item_windows(text: str | None, n: int) -> list[tuple[bytes, ...]]:
    block = next(T.blocks(pa.array([text or ""])))
    data = T.LOWER[block.data]
    found = T.words(T.Block(data, block.bounds, 0), T.NOT_ALNUM)
    all_words = [data[s:e].tobytes() for s, e in zip(found.starts, found.ends, strict=True)]
    size = min(n, len(all_words))
    return [tuple(all_words[k : k + size]) for k in range(len(all_words) - size + 1)] if size else []


def test_set(windows: dict[tuple[int, bytes], set]) -> TestSet:
    """windows: (number of words, words joined by spaces) -> items."""
    by: dict[int, list] = {}
    for (size, spelled), items in windows.items():
        block = next(T.blocks(pa.array([spelled], pa.binary())))
        h = T.window_hashes(T.word_hashes(block, T.words(block)), size)
        by.setdefault(size, []).append((int(h[0]), spelled, tuple(sorted(items, key=str))))
    out = TestSet({}, {}, {})
    for size, found in by.items():
        found.sort(key=lambda x: x[0])
        out.keys[size] = np.array([x[0] for x in found], np.uint64)
        out.spelled[size] = [x[1] for x in found]
        out.items[size] = [x[2] for x in found]
    return out


def parts(tests: DataFrame, item_col: str, text_col: str, n: int, max_windows: int) -> Iterator[TestSet]:
    """The test set in parts of at most max_windows windows, read as a stream so the driver holds one part."""
    held: dict[tuple[int, bytes], set] = {}
    for row in tests.select(col(item_col).alias("i"), col(text_col).cast("string").alias("t")).toLocalIterator():
        for window in item_windows(row.t, n):
            key = (len(window), b" ".join(window))
            if key not in held and len(held) >= max_windows:
                yield test_set(held)
                held = {}
            held.setdefault(key, set()).add(row.i)
    yield test_set(held)


def block_hits(block: T.Block, tests: TestSet) -> tuple[T.Words, np.ndarray, list[set]]:
    """Words of a block, which of them are hit, and the items found in each text."""
    data = T.LOWER[block.data]
    found = T.words(T.Block(data, block.bounds, 0), T.NOT_ALNUM)
    hashes = T.span_hash(T.sums(data), found.starts, found.ends)
    texts = found.texts()
    hit, items = np.zeros(len(found), bool), [set() for _ in range(len(block))]
    for size, keys in tests.keys.items():
        windows = T.window_hashes(hashes, size)
        if not len(windows):
            continue
        maybe = tests.maybe(size, windows)
        maybe = maybe[texts[maybe] == texts[maybe + size - 1]]
        lo, hi = np.searchsorted(keys, windows[maybe], "left"), np.searchsorted(keys, windows[maybe], "right")
        known = np.flatnonzero(lo < hi)
        for k, a, b in zip(maybe[known].tolist(), lo[known].tolist(), hi[known].tolist(), strict=True):
            spelled = b" ".join([data[s:e].tobytes() for s, e in zip(found.starts[k : k + size].tolist(), found.ends[k : k + size].tolist(), strict=True)])
            for which in range(a, b):
                if tests.spelled[size][which] == spelled:
                    hit[k : k + size] = True
                    items[texts[k]].update(tests.items[size][which])
    return found, hit, items


def _spans(found: T.Words, hit: np.ndarray, block: T.Block, i: int) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of hit words of text i."""
    a, b = found.bounds[i], found.bounds[i + 1]
    own = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
    base = block.bounds[i]
    return [(int(found.starts[a + s] - base), int(found.ends[a + e - 1] - base)) for s, e in own.reshape(-1, 2)]


def _cut(found: T.Words, hit: np.ndarray, block: T.Block, i: int) -> bytes:
    """Text i without its hit spans."""
    text, kept, at = block.text(i), [], 0
    for s, e in _spans(found, hit, block, i):
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


SCHEMA = "n_words long, n_hit long, item_ids array<string>, clean_text string"


#: Finds the words of a block of a batch's texts, which of them are hit, and the items found in each text.
Finder = Callable[[pa.RecordBatch, T.Block], tuple[T.Words, np.ndarray, list[set]]]


def _with_last(things: Iterator[TestSet]) -> Iterator[tuple[bool, TestSet]]:
    """Each thing, and whether it is the last one."""
    before = next(things)
    for thing in things:
        yield False, before
        before = thing
    yield True, before


def searched(docs: DataFrame, tests: DataFrame, text_col: str, item_col: str, item_text_col: str, n: int, max_windows: int) -> tuple[DataFrame, Finder]:
    """docs, with further columns at the end if the tests make several parts, and how to find the hits of its texts."""
    if n < 1:
        raise ValueError("n must be at least 1")
    sc, found = docs.sparkSession.sparkContext, None
    text = col(text_col).cast("string")
    keys = (F.xxhash64(text), F.xxhash64(F.lit("2"), text))  # equal texts have equal hits
    texts = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text"))

    def hits(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in T.blocks(batch.column(2)):
                    words, hit, items = block_hits(block, held.value)
                    at = np.flatnonzero(T.per_text(hit, words.bounds)).tolist()
                    own = batch.slice(block.first, len(block)).take(pa.array(at, pa.int64()))
                    places = [np.flatnonzero(hit[words.bounds[i] : words.bounds[i + 1]]).tolist() for i in at]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(places, pa.list_(pa.int32())), pa.array([sorted(map(str, items[i])) for i in at], pa.list_(pa.string()))], names=["k1", "k2", "hit", "items"])

        return run

    for last, part in _with_last(parts(tests, item_col, item_text_col, n, max_windows)):
        held = sc.broadcast(part)
        if last and found is None:
            return docs, lambda batch, block, held=held: block_hits(block, held.value)
        now = written(texts.mapInArrow(hits(held), "k1 long, k2 long, hit array<int>, items array<string>").dropDuplicates(["k1", "k2"]), "hits")
        held.destroy()
        found = now if found is None else found.unionByName(now)
    own1, own2, k1, k2, hit, items = fresh(docs, "own1", "own2", "k1", "k2", "hit", "items")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = found.groupBy("k1", "k2").agg(union("hit").alias(hit), union("items").alias(items)).withColumnsRenamed({"k1": k1, "k2": k2})
    joined = docs.withColumns({own1: keys[0], own2: keys[1]}).join(merged, (F.col(own1) == F.col(k1)) & (F.col(own2) == F.col(k2)), "left").drop(own1, own2, k1, k2)

    def known(batch: pa.RecordBatch, block: T.Block) -> tuple[T.Words, np.ndarray, list[set]]:
        words = T.words(T.Block(T.LOWER[block.data], block.bounds, 0), T.NOT_ALNUM)
        mask, own = np.zeros(len(words), bool), []
        places, names = (batch.column(batch.num_columns - k).slice(block.first, len(block)).to_pylist() for k in (2, 1))
        for i in range(len(block)):
            mask[words.bounds[i] + np.array(places[i] or [], np.int64)] = True
            own.append({*(names[i] or [])})
        return words, mask, own

    return joined, known


def find_hits(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, max_windows: int = MAX_WINDOWS, with_text: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_hit, item_ids (sorted as strings) and the text without its hit spans.

    clean_text is the text itself where nothing is hit; n_hit counts words in any occurrence of a window.
    """
    rows, find = searched(docs.select(col(id_col).alias(id_col), col(text_col).cast("string").alias("own_text")), tests, "own_text", item_col, item_text_col, n, max_windows)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, item_ids array<string>, clean_text string"

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                words, hit, items = find(batch, block)
                counts, clean = T.per_text(hit, words.bounds), None
                if with_text:
                    clean = [(_cut(words, hit, block, i) if counts[i] else block.text(i)).decode() for i in range(len(block))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(np.diff(words.bounds), pa.int64()), pa.array(counts, pa.int64()), pa.array([sorted(map(str, x)) for x in items], pa.list_(pa.string())), pa.array(clean or [None] * len(block), pa.string())],
                    names=[id_col, "n_words", "n_hit", "item_ids", "clean_text"],
                )

    return rows.mapInArrow(hits, schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean_documents(docs: DataFrame, tests: DataFrame, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The training rows without contaminated documents, or with their hit spans cut out (``remove="spans"``).

    Every row is judged on its own text, so repeated keys are no trouble; all columns of the caller stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    rows, find = searched(docs, tests, text_col, item_col, item_text_col, n, max_windows)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, nulls = np.ones(batch.num_rows, bool), [], batch.column(at).is_null().to_pylist()
            for block in T.blocks(batch.column(at)):
                words, hit, _ = find(batch, block)
                counts = T.per_text(hit, words.bounds)
                keep[block.first : block.first + len(block)] = counts == 0
                if remove == "spans":
                    texts += [_cut(words, hit, block, i) if counts[i] else block.text(i) for i in range(len(block))]
            own = batch.select(list(range(width)))
            if remove == "documents":
                yield own.filter(pa.array(keep))
            else:
                new = pa.array([None if x else t.decode() for x, t in zip(nulls, texts, strict=True)], pa.string())
                yield own.set_column(at, own.schema.field(at), new.cast(own.schema.field(at).type))

    return map_rows(rows, clean, width)
