"""Near-duplicates of a stated shingle similarity, where a 64-bit SimHash alone does not tell them.

Texts that share four fifths of their five-word shingles differ in 5 to 14 of 64 bits (measured), while blocks of a
fingerprint can only find pairs within 4. So the links of the SimHash operator are kept, and beside them documents
meet in 16 bands of 4 least shingle hashes. Of those that meet, the ones link whose sets of shingle hashes have the
similarity: every link is verified. A pair right at 0.8 meets in no band with probability 0.0002; no other is lost.

Texts with equal shingle sets and fingerprints are one node before any join. Links are found in two rounds:

1. Each node of a bucket is compared with the least node there. That is one pair a node, and joins most groups.
2. In buckets of three nodes or more that still hold several components, all pairs of unlike components are compared.
   The nodes of a bucket's largest component are dealt over parts, and so are the others; the others' parts meet each
   other and each part of the largest component, in blocks of bounded nodes and bytes. A block returns a spanning
   forest of its links. So a large group with few strays costs in proportion to its size, no task is unbounded, and
   only a bucket of many unlike nodes costs with the square of those.

Edge cases: a text of fewer words than a shingle is one shingle; texts without words (null, empty, blank) are alike;
repeated rows share a node; null keys count as largest; an empty table gives an empty result; a row's other columns
are kept by ``one_of_each`` whatever their names, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import simhash
from harrier.llm import textops as T
from harrier.llm.components import components
from harrier.llm.store import col, fresh, hot_join, written

BANDS, ROWS = 16, 4
PLACES = BANDS * ROWS
#: Nodes and shingles of a part in the second round; two parts make a block.
PART, PART_GRAMS = 2_048, 1_000_000
#: Pairs of the first round that one copy of a shingle set serves.
SHARE = 256
_random = np.random.default_rng(99)
_FACTOR = _random.integers(0, 2**31, PLACES, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 2**32, PLACES, np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of 64 reorderings of the shingle hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(PLACES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _FACTOR + _SHIFT
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(0), out=out)
    return out


def shingle_set(text: bytes, shingle: int) -> tuple[int, np.ndarray]:
    """SimHash fingerprint and sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    hashes = simhash.shingle_hashes(words, shingle)
    return simhash.majority(hashes), np.unique(hashes)


def node_of(fp: int, grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes() + fp.to_bytes(8, "little"))


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sigs), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = T.mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + sigs[:, b * rows + r].astype(np.uint64) + np.uint64(b + 1))
    return keys.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp, keys (of the bands), grams (their number), node (a hash of fp and the shingle set)."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long, keys array<long>, grams int, node long"
    bands, rows = BANDS, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sigs, sizes, nodes = [], [], [], []
            for block in T.blocks(batch.column(1)):
                for i in range(len(block)):
                    fp, grams = shingle_set(block.text(i), shingle)
                    fps.append(fp)
                    sigs.append(signature(grams))
                    sizes.append(len(grams))
                    nodes.append(node_of(fp, grams))
            keys = list(band_keys(np.array(sigs, np.uint32).reshape(-1, PLACES), bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), _lists(keys), pa.array(sizes, pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64))], names=["id", "fp", "keys", "grams", "node"])

    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node, set (of its shingle hashes) for the wanted nodes (node, least): the text of one row of each is read again."""
    ids = wanted.select(F.col("least").alias("want")).distinct()
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    texts = texts.join(ids, F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(0)):
                found = [shingle_set(block.text(i), shingle) for i in range(len(block))]
                nodes = np.array([node_of(*x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists([x[1].view(np.int64) for x in found])], names=["node", "set"])

    sets = texts.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])
    return sets.join(wanted.select("node"), "node", "left_semi")  # rows of equal id may have other texts


def least_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (u, v): each node of a bucket with the least node v there."""
    least = keyed.groupBy("k").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    return hot_join(keyed, least, ["k"], "node", "n", "band-sizes").filter("v < node").select(F.col("node").alias("u"), "v").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the similarity. A node with many pairs is copied for some of them each."""
    pairs = written(pairs, "pairs")
    shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    salted = pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), "shares").cast("int").alias("salt"))
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("b")).join(shares, "v").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    shared = F.size(F.array_intersect("a", "b"))
    both = salted.join(left, "u").join(right, ["v", "salt"]).select("u", "v", shared.alias("shared"), (F.size("a") + F.size("b") - shared).alias("union"))
    return written(both.filter(F.col("shared") >= similarity * F.col("union") - 1e-9).select("u", "v"), "links")


def block_links(nodes: np.ndarray, roots: np.ndarray, parts: np.ndarray, sizes: np.ndarray, grams: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between unlike roots; of two parts, of those across them. grams: sets end to end."""
    order = np.argsort(sizes, kind="stable")
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, named = np.unique(grams, return_inverse=True)
    named = np.concatenate([named[at[i] : at[i + 1]] for i in order.tolist()])
    nodes, parts, sizes = nodes[order], parts[order], sizes[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, label = np.unique(roots[order], return_inverse=True)
    label, across = label.copy(), parts.min() != parts.max()
    mark, us, vs = np.zeros(len(grams) + 1, bool), [], []
    for i in range(len(nodes) - 1):
        hi = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right"))  # a larger set cannot be as similar
        if hi <= i + 1:
            continue
        unlike = label[i + 1 : hi] != label[i]
        if across:
            unlike &= parts[i + 1 : hi] != parts[i]
        todo = np.flatnonzero(unlike) + i + 1
        if not len(todo):
            continue
        mark[named[at[i] : at[i + 1]]] = True
        low, high = int(todo[0]), int(todo[-1]) + 1
        shared = np.add.reduceat(np.concatenate([mark[named[at[low] : at[high]]], [False]]), at[low : high + 1] - at[low], dtype=np.int64)[:-1][todo - low]
        mark[named[at[i] : at[i + 1]]] = False
        for j in todo[shared >= similarity * (sizes[i] + sizes[todo] - shared) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                us.append(nodes[j])
                vs.append(nodes[i])
    return np.array(us, np.int64), np.array(vs, np.int64)


def other_links(keyed: DataFrame, nodes: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between the components (u, root v) that buckets of three nodes or more still hold."""
    sized = nodes.select("node", "grams").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = keyed.join(sized, "node")
    by_root = rooted.groupBy("k", "root").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
    sizes = by_root.groupBy("k").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.max(F.struct("n", "g", "root")).alias("home"), F.count("*").alias("kinds"))
    needed = lambda n, g: F.ceil(F.greatest(n / PART, g / PART_GRAMS)).cast("int")
    sizes = sizes.filter("n > 2 and kinds > 1").select("k", "n", F.col("home.root").alias("home"), needed(F.col("home.n"), F.col("home.g")).alias("homes"), needed(F.col("n") - F.col("home.n"), F.col("g") - F.col("home.g")).alias("others"))
    hashed = F.xxhash64("node", "k")
    dealt = hot_join(rooted, sizes, ["k"], "node", "n", "band-sizes").withColumn("at_home", F.col("root") == F.col("home"))
    dealt = dealt.withColumn("part", F.when(F.col("at_home"), F.pmod(hashed, "homes")).otherwise(F.col("homes") + F.pmod(hashed, "others")).cast("int"))
    first = F.when(F.col("at_home"), F.col("homes")).otherwise(F.lit(0))
    dealt = dealt.select("k", "node", "root", "part", F.explode(F.sequence(first, F.col("homes") + F.col("others") - 1)).alias("other"))
    members = dealt.select("k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "root", "part").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        own, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        us, vs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(own) > 1 and (table.column("i")[0] == table.column("j")[0] or part.min() != part.max()):
            lists = table.column("set").combine_chunks()
            us, vs = block_links(own, root, part, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), similarity)
        return pa.table({"u": pa.array(np.maximum(us, vs)), "v": pa.array(np.minimum(us, vs))})

    return written(members.groupBy("k", "i", "j").applyInArrow(run, "u long, v long").distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, component_id (the least key that links reach) and component_size of each row."""
    drawn = written(sketches(docs, shingle, id_col, text_col), "sketches")
    nodes = written(drawn.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("grams").alias("grams"), F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    of_fp = nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    same = nodes.join(of_fp.filter("n > 1"), "fp").filter("node > rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    ends = simhash.near_links(of_fp.select("fp"))
    ends = ends.join(of_fp.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(of_fp.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v")
    ends = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    keyed = nodes.select("node", F.explode("keys").alias("k"))
    met = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    keyed = written(keyed.join(met, "k"), "bands")
    wanted = nodes.join(keyed.select("node").distinct(), "node").select("node", "least")
    sets = written(shingle_sets(docs, wanted, shingle, id_col, text_col), "shingle-sets")
    stars = components(verified(least_pairs(keyed), sets, similarity).unionByName(same).unionByName(ends))
    stars = components(stars.unionByName(other_links(keyed, nodes, stars, sets, similarity)))
    rooted = nodes.select("node", "least", "n").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    of = rooted.select("node", "root").join(groups, "root").select("node", "component_id", "component_size")
    return drawn.select(F.col("id").alias(id_col), "node").join(of, "node").select(col(id_col), "component_id", "component_size")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose key is the least of their component; all columns stay. Repeated rows of that key all stay."""
    (name,) = fresh(docs, "keep")
    found = near_duplicates(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), shingle, similarity, "id", "text")
    keep = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(name)).distinct()
    return docs.join(keep, col(id_col).eqNullSafe(col(name)), "left_semi")
