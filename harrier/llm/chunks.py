"""The corpus in chunks of whole texts, and exchanges of keys between all chunks.

A chunk is a row with the texts of some documents, end to end and compressed, in ascending order of id. An exchange
asks of keys whether other documents hold them. A chunk sends each distinct key once, in one packed row for each
bucket, so a key that a third of all documents holds costs one entry a chunk and not one a document. Buckets are
ranges of the key's hash; there are as many as the bytes of the corpus ask for, so that a bucket stays as large
whatever the corpus. The answer to a row is a code for each of its keys, in their order, so that answers cost about
a bit a key and are asked by no other name than chunk and bucket.

``shared`` tells which keys two documents hold. It may err on the side of yes (keys are compared by 32 bits and their
bucket), since its answers only spare work. ``earlier`` tells which keys a document of smaller id holds, and decides:
keys are compared by 80 bits of two independent hashes (of words: polynomials modulo 2 ** 61 - 1 at bases drawn once,
under which no unlike words are bound to agree), so two of n different keys meet by chance with probability of about
n * n / 2 ** 81, that is 1e-5 for all windows of 30 GB of text together.

Ids are whole numbers; null ids count as the largest. Documents of equal id count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import textops as T
from harrier.llm.store import col, long_ids, partitions, written

LAST = np.iinfo(np.int64).max
CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 1 << 16
#: Bytes of text for each bucket of an exchange.
BUCKET_BYTES = 16 << 20
ZIP = pa.Codec("zstd", compression_level=3)

CHUNKS = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())])
CHUNKS_SQL = "chunk long, size long, ids binary, nulls binary, lens binary, body binary"
SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
SENT_SQL = "bucket int, chunk long, keys binary, more binary, ids binary, counts binary"
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])
ANSWER_SQL = "chunk long, bucket int, n long, codes binary"


def zipped(data: bytes) -> bytes:
    return ZIP.compress(data, asbytes=True)


def unzipped(body: bytes, size: int) -> bytes:
    return ZIP.decompress(body, decompressed_size=size, asbytes=True) if size else b""


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    pa.default_memory_pool().release_unused()  # what the group before left in the worker's pool
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _chunk(number: int, ids: np.ndarray, nulls: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    block = next(T.blocks(texts.take(pa.array(order)), limit=1 << 62))
    row = (number, len(block.data), ids[order].tobytes(), nulls[order].tobytes(), np.diff(block.bounds).astype(np.uint64).tobytes(), zipped(block.data.tobytes()))
    return table([row], CHUNKS).to_batches()[0]


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents as a table of chunks in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, count = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            own = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = T.strings(batch.column(1)).cast(pa.large_string())
            lens = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
            begin = 0
            while begin < len(own):
                upto = np.cumsum(lens[begin:])
                n = min(CHUNK_DOCS - count, int(np.searchsorted(upto, CHUNK_BYTES - size, "left")) + 1, len(own) - begin)
                held.append((own[begin : begin + n], null[begin : begin + n], texts.slice(begin, n)))
                size, count, begin = size + int(upto[n - 1]), count + n, begin + n
                if size >= CHUNK_BYTES or count >= CHUNK_DOCS:
                    yield _chunk(number, *_joined(held))
                    number, held, size, count = number + 1, [], 0, 0
        if held:
            yield _chunk(number, *_joined(held))

    rows = docs.select(long_ids(docs, id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, CHUNKS_SQL), "chunks")


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])


def dealt(frame: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """frame dealt by its keys over at least as many tasks as there are buckets."""
    return frame.repartition(buckets, *keys) if buckets > partitions(frame.sparkSession) else frame


def bucket_count(chunks: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Buckets for the text of these chunks, of so many bytes each."""
    size = chunks.agg(F.sum("size")).first()[0] or 0
    return max(32, -(-size // each))


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    nulls: np.ndarray
    block: T.Block


def opened(row: dict) -> Chunk:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.uint64).astype(np.int64))])
    block = T.Block(np.frombuffer(unzipped(row["body"], int(at[-1])), np.uint8), at, 0)
    return Chunk(row["chunk"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), block)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Distinct:
    """The distinct keys of a chunk in ascending order.

    of: the place among them of each key asked; first: the first entry that holds each; last: the last one.
    """

    keys: np.ndarray
    of: np.ndarray
    first: np.ndarray
    last: np.ndarray


def distinct(keys: np.ndarray, *more: np.ndarray) -> Distinct:
    """keys: in the order of their documents; entries of equal keys that differ in ``more`` are not joined."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    for other in more:
        new[1:] |= other[order][1:] != other[order][:-1]
    at = np.flatnonzero(new)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return Distinct(ordered[at], of, order[at], order[np.concatenate([at[1:], [len(keys)]]) - 1] if len(keys) else at)


def stretches(new: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of n rows; new: for each row but the first, whether one begins there."""
    at = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else []
    yield from zip(at[:-1], at[1:], strict=True)


def _cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of the ascending keys of each bucket."""
    where = bucket_of(keys, buckets)
    for i, j in stretches(where[1:] != where[:-1], len(where)):
        yield int(where[i]), i, j


def ask_shared(number: int, keys: np.ndarray, weights: np.ndarray, buckets: int) -> pa.Table:
    """keys: distinct, ascending; weights: 0 for a key of one document, else 1 + log2 of how often the chunk has it."""
    rows = [(b, number, keys[i:j].astype(np.uint32).tobytes(), weights[i:j].astype(np.uint8).tobytes(), None, None) for b, i, j in _cuts(keys, buckets)]
    return table(rows, SENT)


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[at], np.diff(np.concatenate([at, [len(owner)]]))


def earlier_order(keys: np.ndarray, ids: np.ndarray, buckets: int) -> np.ndarray:
    """The order in which ``ask_earlier`` sends ascending keys: by bucket, then by id."""
    return np.lexsort((ids, bucket_of(keys, buckets)))


def ask_earlier(number: int, keys: np.ndarray, more: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """keys: distinct, ascending; more: 16 more bits of each; ids: the least id that holds it in the chunk."""
    order, rows = earlier_order(keys, ids, buckets), []
    for b, i, j in _cuts(keys, buckets):
        at = order[i:j]
        names, counts = runs(ids[at])
        rows.append((b, number, keys[at].tobytes(), more[at].astype(np.uint16).tobytes(), names.tobytes(), counts.astype(np.uint32).tobytes()))
    return table(rows, SENT)


def _answers(table_: pa.Table, codes: np.ndarray, counts: np.ndarray) -> pa.Table:
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    rows = [(c, b, n, zipped(codes[i:j].tobytes())) for c, b, n, i, j in zip(table_.column("chunk").to_pylist(), table_.column("bucket").to_pylist(), counts.tolist(), at[:-1], at[1:], strict=True)]
    return table(rows, ANSWER)


def shared(sent: DataFrame, buckets: int, hot: int = 1 << 62) -> DataFrame:
    """Codes of keys: 0 if one document alone holds it, else 1 + n: 2 ** n groups of at most about ``hot`` hold it."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint32)
        weights = np.frombuffer(b"".join(rows.column("more").to_pylist()), np.uint8)
        found = distinct(keys)
        n = np.bincount(found.of, np.where(weights > 0, 2.0 ** np.maximum(weights.astype(float) - 1, 1), 1.0), len(found.keys))
        codes = np.where(n > 1, 1 + np.ceil(np.log2(np.maximum(n / hot, 1))), 0).astype(np.uint8)
        return _answers(rows, codes[found.of], np.array([len(k) // 4 for k in rows.column("keys").to_pylist()], np.int64))

    return dealt(sent, ["bucket"], buckets).groupBy("bucket").applyInArrow(run, ANSWER_SQL)


def earlier(sent: DataFrame, buckets: int) -> DataFrame:
    """Codes of keys: 1 if another chunk holds it in a document of smaller id than the asking chunk does, else 0."""

    def run(rows: pa.Table) -> pa.Table:
        keys, more, names, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("more", np.uint16), ("ids", np.int64), ("counts", np.uint32)))
        ids = np.repeat(names, counts)
        order = np.lexsort((more, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        at = np.flatnonzero(new)
        least = np.empty(len(keys), np.int64)
        if len(keys):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.concatenate([at, [len(keys)]])))
        return _answers(rows, (least < ids).astype(np.uint8), np.array([len(k) // 8 for k in rows.column("keys").to_pylist()], np.int64))

    return dealt(sent, ["bucket"], buckets).groupBy("bucket").applyInArrow(run, ANSWER_SQL)


def codes(answers: list[dict]) -> np.ndarray:
    """The codes of one chunk's keys, in the order of the buckets."""
    return np.frombuffer(b"".join(unzipped(a["codes"], a["n"]) for a in sorted(answers, key=lambda a: a["bucket"])), np.uint8)


def with_answers(chunks: DataFrame, answers: DataFrame, buckets: int):
    """Each chunk's row together with the answers for it, for applyInArrow."""
    return dealt(chunks, ["chunk"], buckets).groupBy("chunk").cogroup(dealt(answers, ["chunk"], buckets).groupBy("chunk"))
