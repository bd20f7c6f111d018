"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is split into 6 blocks. Two fingerprints that differ in at most 4 bits agree on at least 2
whole blocks, so they meet in one of the 15 tables keyed by a pair of blocks. Equal fingerprints are one node
before any join, so copies never form pairs. The nodes of a bucket are compared there, and a bucket returns no
pairs but a spanning forest: each node with the least node that its links in the bucket reach. A bucket of more
than ``PAIRWISE`` nodes is not compared pair by pair: nodes within 4 bits share a point within 2 bits of both, so
each of its nodes is listed under the 2,081 points within 2 bits of it, and a point holds at most 2,081 nodes.
Components of all forests come from star rounds on Spark.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle are one shingle; a bit set in exactly half the shingles is 0; repeated rows share a node; an empty table
gives an empty result. Only the key and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import textops as T
from harrier.llm.components import components
from harrier.llm.store import written

#: First bit and width of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
DISTANCE = 4
PAIRWISE = 16_384
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """text: UTF-8. Words are lower-cased (A-Z) runs of other bytes than ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    return majority(shingle_hashes(words, shingle))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of so many words, joined by spaces; fewer words are one run."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and fingerprint (a long with the 64 bits) of each row."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for block in T.blocks(batch.column(1)):
                for i in range(len(block)):
                    fps[block.first + i] = fingerprint(block.text(i), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within the distance, found in strips of bounded size."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(fps)))
    for i in range(0, len(fps), step):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + step, None] ^ fps[None, i:]) <= distance)
        keep = b > a
        left.append(a[keep] + i)
        right.append(b[keep] + i)
    return np.concatenate(left), np.concatenate(right)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node its links reach) for nodes that are not the least themselves. fps: int64, distinct."""
    a, b = _links(fps.view(np.uint64), distance)
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none
    order = np.argsort(fps, kind="stable")
    place = np.empty(len(fps), np.int64)
    place[order] = np.arange(len(fps))
    a, b, root = place[a], place[b], np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[order[moved]], fps[order[root[moved]]]


def block_keys(fp: str = "fp") -> F.Column:
    """The 15 (table, key) pairs of a fingerprint, each packed into one long."""
    parts = [F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in BLOCKS]
    pairs = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
    return F.array(*[F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(parts[i], 11)).bitwiseOR(parts[j]) for t, (i, j) in enumerate(pairs)])


def close_points(radius: int = DISTANCE // 2) -> list[int]:
    """Masks of at most so many bits, as signed 64-bit numbers."""
    out = [0]
    for r in range(1, radius + 1):
        for bits in combinations(range(64), r):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def near_links(nodes: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """nodes: distinct fp -> edges (u, v) with v < u whose components are those of all pairs within 4 bits."""
    keys = nodes.select("fp", F.explode(block_keys()).alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    sized = written(keys.join(sizes, "k").select("k", "fp", "n"), "buckets")
    few = sized.filter(F.col("n") <= pairwise).groupBy("k").agg(F.collect_list("fp").alias("fps")).select("fps")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            sizes = np.diff(at)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = np.flatnonzero(sizes == 2)  # most buckets: all at once
            a, b = values[at[two]], values[at[two] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
            us.append(np.maximum(a, b)[near])
            vs.append(np.minimum(a, b)[near])
            for i in np.flatnonzero(sizes > 2):
                u, v = forest(values[at[i] : at[i + 1]])
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    small = few.mapInArrow(spans, "u long, v long")
    hot = sized.filter(F.col("n") > pairwise).select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in close_points()])
    points = hot.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("p"))
    met = points.groupBy("p").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    large = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("v < u").select("u", "v")
    return small.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, fp, component_id (the least key that links reach) and component_size (rows) of each row.

    Fingerprints that differ in at most 4 of 64 bits link. Keys must be comparable; null keys count as largest.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "nodes")
    stars = components(near_links(nodes.select("fp")))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    of = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id", "component_size")
    return fps.join(of, "fp").select(id_col, "fp", "component_id", "component_size")
