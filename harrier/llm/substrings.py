"""Suffix-array dedup of byte strings.

1. Texts are cut into excerpts at content-chosen anchors (see anchors). Every string of ``length`` bytes lies in one
   excerpt, and equal strings lie in excerpts of equal anchors, so anchors deal equal strings to the same shard. An
   exchange (see chunks) tells which anchors one document alone holds; their excerpts go no further.
2. All other excerpts are dealt to groups by anchor. A chunk sends equal excerpts once, with their least id. A group
   sorts its distinct excerpts by anchor and cuts them into shards of bounded size. Each shard gets a suffix array by
   Larsson-Sadakane refinement and common prefixes by Kasai; suffixes that share ``length`` bytes are equal strings.
   Where an anchor fills more than a shard, the shards that hold it are merged by binary search: each shard's distinct
   strings, in suffix order, are looked up in those of the shards before, and the least id of each string is kept.
3. An anchor with more than ``HOT`` different excerpts is dealt over several groups by the excerpts' hashes, and the
   distinct strings of those are merged by a grouping of string hashes, so no group is unbounded.
4. A bit for each string returns to the chunk that sent it: whether a document of smaller id holds the string.

So every decision on a string that two documents hold comes from a suffix array. Anchors decide only where strings
meet and which of them have no partner.

Removed is each byte covered by a ``length``-byte string that also starts in a document of smaller id; overlaps
count, matches never cross documents, and strings are judged on the input.

Edge cases: a null or empty text has 0 bytes and an empty result; texts shorter than a string lose nothing;
documents of equal id never remove bytes of each other; null ids count as the largest; ids must be whole numbers,
others raise a TypeError; kept bytes may cut a character in two, so they are bytes; a text longer than a chunk is a
chunk of its own; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import chunks as C
from harrier.llm import suffix_arrays as S
from harrier.llm import textops as T
from harrier.llm.anchors import Runs, anchored
from harrier.llm.store import written

LENGTH = 50
#: Bytes of an anchor's gram: long enough that equal grams in unlike contexts are rare.
GRAM = 20
SHARD_BYTES = 1 << 19
#: Bytes of text for each group of excerpts; and different excerpts of one anchor in a group.
GROUP_BYTES = 4 << 20
HOT = 20_000
RESULT = pa.schema([("id", pa.int64()), ("no_id", pa.bool_()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("sha", pa.string()), ("kept", pa.binary())])
RESULT_SQL = "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, spans array<long>, sha string, kept binary"
#: Excerpts of a chunk for one group. at: where their strings start in the chunk, for those of hot anchors.
SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("lens", pa.binary()), ("keys", pa.binary()), ("at", pa.binary()), ("body", pa.binary())])
SENT_SQL = "bucket int, part int, chunk long, ids binary, counts binary, lens binary, keys binary, at binary, body binary"
#: Bits of a sent row's strings; or, of a hot anchor's strings, two hashes, the least id in the group and where it is.
BITS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])
BITS_SQL = "chunk long, bucket int, part int, n long, bits binary, w1 long, w2 long, id long, at long"


class Excerpts:
    """The runs of strings of a chunk. Equal excerpts of a chunk stand behind their first one, which has the least id."""

    def __init__(self, chunk: C.Chunk, length: int, gram: int):
        self.chunk, self.length = chunk, length
        found, hashes = [], []
        for part in T.parts(chunk.block):
            sums, at = T.prefix(part.data), chunk.block.bounds[part.first]
            own = anchored(sums, part.bounds, length, gram)
            hashes.append(T.span_hash(T.sums(part.data), own.start, own.end + length - 1))
            found.append((own.start + at, own.end + at, own.text + part.first, own.key))
        none = np.zeros(0, np.int64)
        start, end, text = (np.concatenate([none, *(f[k] for f in found)]) for k in range(3))
        self.runs = Runs(start, end, text, np.concatenate([none.astype(np.uint64), *(f[3] for f in found)]))
        self.ids = chunk.ids[text]
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])
        # equal excerpts have equal anchors: two hashes and the length tell others apart
        same = C.distinct(self.hash, self.runs.key, end - start)
        self.leader = same.first[same.of]  # of each run, the first with an equal excerpt
        self.keys = C.distinct(self.runs.key)

    def ask(self, buckets: int) -> pa.Table:
        first, last = self.ids[self.keys.first], self.ids[self.keys.last]
        leads = self.leader == np.arange(len(self.runs))
        kinds = np.bincount(self.keys.of[leads], minlength=len(self.keys.keys))
        weights = np.where((first != last) | (kinds > 1), 1 + np.ceil(np.log2(np.maximum(kinds, 1))), 0)
        return C.ask_shared(self.chunk.number, self.keys.keys, weights, buckets)

    def dealt(self, codes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Bucket, part (0: not of a hot anchor) and the runs of each group, first ones of equal excerpts only."""
        code = codes[self.keys.of]
        send = np.flatnonzero((code > 0) & (self.leader == np.arange(len(self.runs))))
        bucket = C.bucket_of(self.runs.key[send], buckets)
        level = code[send].astype(np.uint64) - np.uint64(1)
        part = np.where(level > 0, 1 + (self.hash[send] & ((np.uint64(1) << level) - np.uint64(1))).astype(np.int64), 0)
        order = np.lexsort((part, bucket))
        bucket, part, send = bucket[order], part[order], send[order]
        for i, j in C.stretches((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]), len(send)):
            yield int(bucket[i]), int(part[i]), send[i:j]

    def send(self, codes: np.ndarray, buckets: int) -> pa.Table:
        rows, raw = [], self.chunk.block.data.tobytes()
        for bucket, part, at in self.dealt(codes, buckets):
            start, end = self.runs.start[at], self.runs.end[at] + self.length - 1
            names, counts = C.runs(self.ids[at])
            body = b"".join([raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)])
            rows.append((bucket, part, self.chunk.number, names.tobytes(), counts.astype(np.uint32).tobytes(), (end - start).astype(np.uint8).tobytes(), self.runs.key[at].astype(np.uint32).tobytes(), start.tobytes() if part else None, C.zipped(body)))
        return C.table(rows, SENT)

    def gone(self, codes: np.ndarray, buckets: int, bits: dict[tuple[int, int], np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Bytes covered by a string that a document of smaller id holds. starts: such strings of hot anchors."""
        begins = np.zeros(len(self.chunk.block.data) + 1, bool)
        size = self.runs.end - self.runs.start
        for bucket, part, at in self.dealt(codes, buckets):
            told = bits.get((bucket, part))
            if told is not None:
                begins[_spread(self.runs.start[at], size[at])] = told
        begins[starts] = True
        # an equal excerpt of a larger id is covered whole; one of the same id as its leader is
        later = np.flatnonzero(self.ids > self.ids[self.leader])
        begins[_spread(self.runs.start[later], size[later])] = True
        like = np.flatnonzero((self.ids == self.ids[self.leader]) & (self.leader != np.arange(len(self.runs))))
        begins[_spread(self.runs.start[like], size[like])] |= begins[_spread(self.runs.start[self.leader[like]], size[like])]
        hit = np.flatnonzero(begins)
        return T.covered(hit, hit + self.length, len(self.chunk.block.data))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts, starts + 1, ... of each, so many."""
    return np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shards(keys: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int, bool]]:
    """Begin and end of shards of excerpts in order of their keys, and whether it goes on with the last one's key.

    A shard ends where a key ends, if that keeps it within the limit; a key that fills more is cut.
    """
    begin, n = 0, len(keys)
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1 if n else keys
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    goes_on = False
    while begin < n:
        most = max(begin + 1, int(np.searchsorted(upto, upto[begin] + limit, "right")) - 1)
        k = int(np.searchsorted(ends, most, "right")) - 1
        end = int(ends[k]) if k >= 0 and ends[k] > begin else most
        if goes_on:  # the rest of a cut key stays alone, so only its own shards are merged
            end = min(end, int(ends[np.searchsorted(ends, begin, "right")]))
        yield begin, end, goes_on
        goes_on = end < n and keys[end] == keys[end - 1]
        begin = end


def merge_shards(table: pa.Table, length: int, limit: int = SHARD_BYTES) -> pa.Table:
    """The excerpts of a group -> for each row, bits of its strings; and of hot anchors the group's distinct strings."""
    rows = table.to_pylist()
    place: dict[bytes, int] = {}  # distinct excerpts, which have equal anchors: each is in one suffix array
    of, ids, bodies, keys, counts, places = array("q"), [], [], array("I"), [], []
    for number, row in enumerate(rows):
        lens, key = np.frombuffer(row["lens"], np.uint8), np.frombuffer(row["keys"], np.uint32).tolist()
        whole, begin = C.unzipped(row["body"], int(lens.sum())), 0
        for k, end in zip(key, np.cumsum(lens, dtype=np.int64).tolist(), strict=True):
            body = whole[begin:end]
            at = place.setdefault(body, len(bodies))
            if at == len(bodies):
                bodies.append(body)
                keys.append(k)
            of.append(at)
            begin = end
        ids.append(np.repeat(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.uint32)))
        counts.append(len(key))
        places.append(np.frombuffer(row["at"], np.int64) if row["at"] is not None else np.full(len(key), -1))
    place.clear()
    of_, id_ = np.frombuffer(of, np.int64), np.concatenate([np.zeros(0, np.int64), *ids])
    size = np.fromiter(map(len, bodies), np.int64, len(bodies)) - length + 1
    first = np.full(len(bodies), C.LAST)
    np.minimum.at(first, of_, id_)
    order = np.argsort(np.frombuffer(keys, np.uint32), kind="stable")
    at_string = np.concatenate([[0], np.cumsum(size[order])])  # strings, in order of their excerpts
    least = np.full(int(at_string[-1]), C.LAST)
    chain: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of shards that hold one key: where, strings, numbers

    def settle() -> None:
        """Shards that hold one key, merged in pairs; then each looks its strings up."""
        lists = [(rows_, least[where][np.unique(group, return_index=True)[1]]) for where, rows_, group in chain]
        while len(lists) > 1:
            lists = [S.merged(*lists[k : k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
        for where, rows_, group in chain:
            least[where] = lists[0][1][S.find(lists[0][0], rows_)[0]][group]
        chain.clear()

    sorted_keys = np.frombuffer(keys, np.uint32)[order]
    found = list(_shards(sorted_keys, (size + length - 1)[order], limit))
    for number, (begin, end, goes_on) in enumerate(found):
        if not goes_on and chain:
            settle()
        part = order[begin:end]
        data = np.frombuffer(b"\0".join([bodies[k] for k in part.tolist()]) + b"\0", np.uint8)
        lens = size[part] + length
        which = np.repeat(np.arange(len(part)), lens)
        inside = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
        valid = inside < size[part][which]
        starts, group, heads = S.repeated(data, valid, length)
        owner = first[part][which[starts]]
        low = np.full(int(group[-1]) + 1 if len(group) else 0, C.LAST)
        np.minimum.at(low, group, owner)
        where = at_string[begin + which[starts]] + inside[starts]
        least[where] = low[group]
        if goes_on or (number + 1 < len(found) and found[number + 1][2]):
            head = np.unique(group, return_index=True)[1]
            chain.append((where, S.spelled(heads, starts[head], length), group))
    if chain:
        settle()
    back = np.empty(len(bodies), np.int64)
    back[order] = np.arange(len(bodies))
    out, hot, cut = [], [], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tolist()
    for row, i, j, at in zip(rows, cut[:-1], cut[1:], places, strict=True):
        mine, own = back[of_[i:j]], id_[i:j]
        sizes = size[of_[i:j]]
        strings = _spread(at_string[mine], sizes)
        bits = np.repeat(own, sizes) > least[strings]
        out.append((row["chunk"], row["bucket"], row["part"], len(bits), C.zipped(np.packbits(bits).tobytes()), None, None, None, None))
        if row["part"]:
            data = np.frombuffer(b"".join(bodies[k] for k in of[i:j]), np.uint8)
            begins = np.cumsum(sizes + length - 1) - (sizes + length - 1)
            open_ = np.flatnonzero(~bits)
            here = _spread(begins, sizes)[open_]
            w1, w2 = (T.span_hash(T.sums(data, k), here, here + length, k).view(np.int64) for k in (0, 1))
            hot.append(pa.table({"chunk": np.full(len(here), row["chunk"]), "w1": w1, "w2": w2, "id": np.repeat(own, sizes)[open_], "at": _spread(at, sizes)[open_]}))
    made = pa.concat_tables([C.table(out, BITS), *hot], promote_options="default")
    del rows, bodies, out, hot, least
    pa.default_memory_pool().release_unused()
    return made


def _result(block: T.Block, i: int, gone: np.ndarray, with_text: bool) -> tuple:
    own = gone[block.bounds[i] : block.bounds[i + 1]]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    kept = block.data[block.bounds[i] : block.bounds[i + 1]][~own].tobytes() if len(runs) else block.text(i)
    return len(own), int(own.sum()), len(runs) // 2, runs.tolist(), hashlib.sha256(kept).hexdigest(), kept if with_text else None


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (start, end, ... in bytes), kept_sha256 and, if asked, kept_bytes."""
    if not 0 < gram <= length or 2 * length - gram > 255:
        raise ValueError("gram must be between 1 and length, and 2 * length - gram at most 255")
    chunks = C.chunked(docs, id_col, text_col)
    buckets, limit = C.bucket_count(chunks, GROUP_BYTES), SHARD_BYTES

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from Excerpts(C.opened(batch.slice(i, 1).to_pylist()[0]), length, gram).ask(buckets).to_batches()

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return Excerpts(C.opened(rows.to_pylist()[0]), length, gram).send(C.codes(answers.to_pylist()), buckets)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        excerpts, told = Excerpts(C.opened(rows.to_pylist()[0]), length, gram), answers.to_pylist()
        codes = C.codes([a for a in told if a["codes"] is not None])
        bits = {(a["bucket"], a["part"]): np.unpackbits(np.frombuffer(C.unzipped(a["bits"], (a["n"] + 7) // 8), np.uint8), count=a["n"]).astype(bool) for a in told if a["bits"] is not None}
        starts = np.array([a["at"] for a in told if a["at"] is not None], np.int64)
        gone, chunk = excerpts.gone(codes, buckets, bits, starts), excerpts.chunk
        return C.table([(chunk.ids[i], chunk.nulls[i], *_result(chunk.block, i, gone, with_text)) for i in range(len(chunk.block))], RESULT)

    codes = written(C.shared(chunks.mapInArrow(ask, C.SENT_SQL), buckets, hot), "anchor-answers")
    sent = C.with_answers(chunks, codes, buckets).applyInArrow(send, SENT_SQL)
    told = written(C.dealt(sent, ["bucket", "part"], buckets).groupBy("bucket", "part").applyInArrow(lambda t: merge_shards(t, length, limit), BITS_SQL), "string-answers")
    strings = told.filter("w1 is not null").select("chunk", "w1", "w2", "id", "at")
    least = strings.groupBy("w1", "w2").agg(F.min("id").alias("least"))
    spread = strings.join(least, ["w1", "w2"]).filter("id > least").select("chunk", "at")
    answers = codes.unionByName(told.filter("bits is not null").select("chunk", "bucket", "part", "n", "bits"), allowMissingColumns=True).unionByName(spread, allowMissingColumns=True)
    out = C.with_answers(chunks, answers, buckets).applyInArrow(finish, RESULT_SQL)
    return out.select(F.when(~F.col("no_id"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", F.col("sha").alias("kept_sha256"), *([F.col("kept").alias("kept_bytes")] if with_text else []))
