"""Substring dedup on words by level-wise doubling.

Level by level, only windows that repeat across documents are extended to twice their length: first all runs of 4
words are exchanged (see chunks), then of 8, doubling up to ``length``. A window of full length stays a candidate as
long as all runs of the level's length within it repeat; a level exchanges the runs of candidates only, so one that a
single document holds is dropped there. The last level, at full length, decides every candidate that is left. A level
replays those before it from their answers, which are bits; so nothing but chunks and bits is kept between levels.

Removed is each word covered by a window whose word sequence also starts in a document of smaller id; windows are
judged on the input. Windows are compared by 80 bits of their hashes at the level that decides (see chunks for the
chance of an error).

Edge cases: a null, empty or blank text has no words and an empty result; texts of fewer words than a window lose
nothing; documents of equal id never remove words of each other; null ids count as the largest; ids must be whole
numbers, others raise a TypeError; a text longer than a chunk is a chunk of its own; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import chunks as C
from harrier.llm import textops as T
from harrier.llm.store import written

LENGTH = 13
FIRST = 4
RESULT = pa.schema([("id", pa.int64()), ("no_id", pa.bool_()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("sha", pa.string()), ("kept", pa.string())])
RESULT_SQL = "id long, no_id boolean, n_words long, n_removed long, spans array<long>, sha string, kept string"


def lengths(length: int, first: int = FIRST) -> list[int]:
    """The lengths of the levels: doubled from first, the last one capped."""
    out = [min(first, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Windows:
    """Candidate windows of a chunk: level by level, those go of which a run does not repeat."""

    def __init__(self, chunk: C.Chunk, length: int):
        self.chunk, self.length = chunk, length
        self.found = T.words(chunk.block)
        self.words = [T.word_hashes(chunk.block, self.found, which) for which in (0, 1)]
        self.alive = T.window_fits(self.found.bounds, length)
        self.owner = self.found.texts()

    def hashes(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        return T.window_hashes(self.words[which], size)[at]

    def level(self, size: int) -> tuple[np.ndarray, C.Distinct]:
        """Starts of the runs of so many words within candidates, and their distinct keys."""
        alive = np.flatnonzero(self.alive)
        at = np.flatnonzero(T.covered(alive, alive + self.length - size + 1, len(self.found)))
        return at, C.distinct(self.hashes(at, size))

    def drop(self, size: int, codes: np.ndarray) -> None:
        """Candidates stay if all their runs repeat."""
        at, keys = self.level(size)
        repeats = np.zeros(len(self.found) + 1, np.int64)
        repeats[at + 1] = codes[keys.of] > 0
        repeats = np.cumsum(repeats)
        runs = self.length - size + 1
        self.alive &= repeats[runs : runs + len(self.alive)] - repeats[: len(self.alive)] == runs

    def ask(self, size: int, buckets: int) -> pa.Table:
        at, keys = self.level(size)
        ids = self.chunk.ids[self.owner[at]]
        if size < self.length:
            return C.ask_shared(self.chunk.number, keys.keys, ids[keys.first] != ids[keys.last], buckets)
        return C.ask_earlier(self.chunk.number, keys.keys, self.hashes(at[keys.first], size, 1), ids[keys.first], buckets)

    def gone(self, codes: np.ndarray, buckets: int) -> np.ndarray:
        """Words covered by a window that a document of smaller id holds, in another chunk or in this one."""
        at, keys = self.level(self.length)
        ids = self.chunk.ids[self.owner[at]]
        least = ids[keys.first]
        told = np.zeros(len(keys.keys), bool)
        told[C.earlier_order(keys.keys, least, buckets)] = codes > 0
        hit = at[told[keys.of] | (ids > least[keys.of])]
        return T.covered(hit, hit + self.length, len(self.found))


def _result(block: T.Block, found: T.Words, i: int, gone: np.ndarray, with_text: bool) -> tuple[int, list[int], str, str | None]:
    """Removed words of text i, their runs (start, end, start, ...), digest and text of the kept words."""
    a, b = found.bounds[i], found.bounds[i + 1]
    own = gone[a:b]
    if not own.any():
        words = block.text(i).split()
    else:
        words = [block.data[s:e].tobytes() for s, e in zip(found.starts[a:b][~own].tolist(), found.ends[a:b][~own].tolist(), strict=True)]
    kept = b" ".join(words)
    runs = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    return int(own.sum()), runs.tolist(), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None


def remove_repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, first: int = FIRST) -> DataFrame:
    """id, n_words, n_removed, spans (start, end, ... of removed runs, in words), kept_sha256 and, if asked, kept_text."""
    if length < 1 or first < 1:
        raise ValueError("a window needs at least one word")
    chunks = C.chunked(docs, id_col, text_col)
    buckets, levels = C.bucket_count(chunks), lengths(length, first)

    def replayed(row: dict, answers: list[dict], upto: int) -> Windows:
        windows = Windows(C.opened(row), length)
        for k in range(upto):
            windows.drop(levels[k], C.codes([a for a in answers if a["level"] == k]))
        return windows

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from replayed(batch.slice(i, 1).to_pylist()[0], [], 0).ask(levels[0], buckets).to_batches()

    def ask_next(level: int):
        return lambda rows, answers: replayed(rows.to_pylist()[0], answers.to_pylist(), level).ask(levels[level], buckets)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        told, last = answers.to_pylist(), len(levels) - 1
        windows = replayed(rows.to_pylist()[0], told, last)
        gone = windows.gone(C.codes([a for a in told if a["level"] == last]), buckets)
        chunk, found, out = windows.chunk, windows.found, []
        for i in range(len(chunk.block)):
            out.append((chunk.ids[i], chunk.nulls[i], found.bounds[i + 1] - found.bounds[i], *_result(chunk.block, found, i, gone, with_text)))
        return C.table(out, RESULT)

    answers = None
    for level, size in enumerate(levels):
        asked = chunks.mapInArrow(ask_first, C.SENT_SQL) if answers is None else C.with_answers(chunks, answers, buckets).applyInArrow(ask_next(level), C.SENT_SQL)
        told = C.earlier(asked, buckets) if size == length else C.shared(asked, buckets)
        told = written(told.withColumn("level", F.lit(level)), "window-answers")
        answers = told if answers is None else answers.unionByName(told)
    out = C.with_answers(chunks, answers, buckets).applyInArrow(finish, RESULT_SQL)
    return out.select(F.when(~F.col("no_id"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "spans", F.col("sha").alias("kept_sha256"), *([F.col("kept").alias("kept_text")] if with_text else []))
