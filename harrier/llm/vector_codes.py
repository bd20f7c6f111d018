"""Vector code compression: product quantisation by Lloyd rounds with the filtering algorithm, in whole numbers.

Components become floor(1024 * x). A vector is cut into equal parts; every part position has a codebook of 256 entries.
Rows are packed in chunks of some thousand vectors. A task builds one kd-tree over each chunk and part position, with
the bounding box, sum and count of every node, and writes it down once: the vectors in tree order, so that a node is a
range of rows. A round walks down a tree with the entries that may still be nearest somewhere in a node: an entry goes
if another one is nearer all over the node's box, and a node with one entry left is assigned as a whole, from its sums.
Leaves compare what is left. Entries are moved by sums and counts, added up by Spark for each part and entry; only the
codebooks, of fixed size, pass the driver.

All distances are exact. Ties go to the entry of lower index: an entry that can at best tie with one of lower index all
over a box goes, one that can tie and has the lower index stays.

Edge cases: rows with a null vector, or null or non-finite components, are left out; an empty vector counts as kept, with
code 00 for each part and error 0. Kept vectors of several lengths, of a length that the parts do not divide, or with
components so large that a sum of squares leaves 64 bits raise a ValueError. Of repeated ids the vector that sorts first
is the smaller one in the first codebooks, and every row has a result; null ids are larger than all others. Fewer than
256 rows make smaller codebooks; an empty table, or one that keeps no row, gives an empty result. A label of very many
rows is dealt over groups. Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.store import col, hot_join, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a chunk at most, and of a leaf.
CHUNK, LEAF = 4_096, 16
TREES = "part int, rows binary, bodies binary"


def split(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Bounds of the nodes of each level of a tree over n rows, halved until a level's nodes hold ``leaf`` rows at most."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        levels.append(np.unique(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return levels


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of a kd-tree: each node is halved at the median of its widest dimension."""
    order = np.arange(len(points))
    for bounds in split(len(points), leaf)[:-1]:
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = points[order[a:b]]
            wide = int(np.argmax(own.max(0) - own.min(0))) if points.shape[1] else 0
            if points.shape[1] and b - a > 1:
                order[a:b] = order[a:b][np.argpartition(own[:, wide], (b - a) // 2)]
    return order


@dataclass
class Tree:
    """Rows in tree order; low, high and total of the nodes of each level, whose rows are bounds[level]."""

    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """points are in tree order. Sums are cached from the leaves upwards."""
        bounds = split(len(points), leaf)
        at = bounds[-1][:-1]
        low, high, total = [np.minimum.reduceat(points, at)], [np.maximum.reduceat(points, at)], [np.add.reduceat(points, at)]
        for fine, coarse in zip(bounds[:0:-1], bounds[-2::-1], strict=True):
            at = np.searchsorted(fine, coarse[:-1])
            low.insert(0, np.minimum.reduceat(low[0], at))
            high.insert(0, np.maximum.reduceat(high[0], at))
            total.insert(0, np.add.reduceat(total[0], at))
        return cls(points, bounds, low, high, total)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest entry of each row, sums and counts by entry, and how many nodes were assigned as a whole."""
        nearest = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros((len(book), self.points.shape[1]), self.points.dtype), np.zeros(len(book), np.int64)
        size, whole = (book * book).sum(1), 0
        nodes, may = np.array([0]), np.ones((1, len(book)), bool)
        for level, bounds in enumerate(self.bounds):
            if not len(nodes):
                break
            may = may & filtered(self.low[level][nodes], self.high[level][nodes], book, size, may)
            alone = may.sum(1) == 1
            if alone.any():
                entry, done = may[alone].argmax(1), nodes[alone]
                np.add.at(sums, entry, self.total[level][done])
                np.add.at(counts, entry, bounds[done + 1] - bounds[done])
                for e, node in zip(entry.tolist(), done.tolist(), strict=True):
                    nearest[bounds[node] : bounds[node + 1]] = e
                nodes, may, whole = nodes[~alone], may[~alone], whole + len(done)
            if level + 1 < len(self.bounds):  # the parts of what is left
                fine = self.bounds[level + 1]
                first, last = np.searchsorted(fine, bounds[nodes]), np.searchsorted(fine, bounds[nodes + 1])
                owner = np.repeat(np.arange(len(nodes)), last - first)
                nodes = np.arange(len(owner)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[owner]
                may = may[owner]
        if len(nodes):
            bounds = self.bounds[-1]
            lengths = bounds[nodes + 1] - bounds[nodes]
            owner = np.repeat(np.arange(len(nodes)), lengths)
            rows = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + bounds[nodes][owner]
            for a in range(0, len(rows), 4_096):
                some = rows[a : a + 4_096]
                away = size - 2 * (self.points[some] @ book.T)
                away[~may[owner[a : a + 4_096]]] = np.iinfo(np.int64).max if away.dtype.kind == "i" else np.inf
                nearest[some] = away.argmin(1)
            np.add.at(sums, nearest[rows], self.points[rows])
            counts += np.bincount(nearest[rows], minlength=len(book))
        return nearest, sums, counts, whole


def filtered(low: np.ndarray, high: np.ndarray, book: np.ndarray, size: np.ndarray, may: np.ndarray) -> np.ndarray:
    """For boxes (rows) and entries (columns): whether the entry may be nearest to some point of the box.

    The entry nearest to the middle of a box is its rival. Over a box, the distance to an entry less that to the rival
    is linear, and least at one corner: if it is above 0 there, or 0 and the rival has the lower index, the entry goes.
    """
    middle = size - (low + high) @ book.T  # distance to the middle, less what all entries share
    middle[~may] = np.iinfo(np.int64).max if middle.dtype.kind == "i" else np.inf
    rival = middle.argmin(1)
    rivals = book[rival]
    # the least value over the box of size - size(rival) - 2 * (entry - rival) . x, each dimension at its own end
    least = size[None, :] - size[rival][:, None]
    for d in range(book.shape[1]):
        step = book[:, d][None, :] - rivals[:, d][:, None]
        least -= 2 * np.where(step > 0, step * high[:, d][:, None], step * low[:, d][:, None])
    index = np.arange(len(book))
    return (least < 0) | ((least == 0) & (index[None, :] <= rival[:, None]))


def kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, vector (whole numbers), label and spread (of no meaning, to deal rows by) of the rows that count."""
    x = F.transform(col(vector_col), lambda v: v.cast("double"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = rows.select(col(id_col).alias("id"), x.alias("x"), col(label_col).alias("label")).filter(F.col("x").isNotNull() & finite)
    return found.select("id", F.transform("x", lambda v: F.floor(v * SCALE)).alias("vector"), "label", F.xxhash64("x", F.col("id").cast("string")).alias("spread"))


def exact(limit: int, width: int) -> type:
    """The numbers in which squared distances of so many components below limit are exact."""
    most = 4 * limit * limit * max(1, width)
    if most >= 2**63:
        raise ValueError("components are too large for sums of squares in 64 bits")
    return np.float64 if 2 * most < 2**53 else np.int64


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    return flat.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def built(rows: DataFrame, width: int, parts: int, kind: type, chunk: int = CHUNK) -> DataFrame:
    """row (a number of its own), id, label, and for each chunk and part the tree: rows and vectors in tree order."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= chunk:
                table = pa.Table.from_batches(held)
                yield from trees(table.slice(0, chunk))
                held, n = table.slice(chunk).to_batches(), n - chunk
        if n:
            yield from trees(pa.Table.from_batches(held))

    def trees(table: pa.Table) -> Iterator[pa.RecordBatch]:
        points, numbers = matrix(table["vector"], width, kind), table["row"].to_numpy()
        out = []
        for part in range(parts):
            own = points[:, part * size : (part + 1) * size]
            order = tree_order(own)
            out.append((part, numbers[order].tobytes(), np.ascontiguousarray(own[order]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[k] for o in out], pa.binary()) for k in (1, 2)]], names=["part", "rows", "bodies"])

    return rows.select("row", "vector").mapInArrow(run, TREES)


def opened(batch: pa.RecordBatch, i: int, size: int, kind: type) -> tuple[int, np.ndarray, Tree]:
    rows = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
    return batch.column(0)[i].as_py(), rows, Tree.of(np.frombuffer(batch.column(2)[i].as_py(), kind).reshape(len(rows), size))


def moved(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round. The driver sees a row for each part and entry."""
    size, kind, held = books[0].shape[1], books[0].dtype.type, trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in held.value]
        counts = [np.zeros(len(b), np.int64) for b in held.value]
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, tree = opened(batch, i, size, kind)
                _, s, c, _ = tree.assign(held.value[part])
                sums[part] += s.astype(np.int64)
                counts[part] += c
        rows = [(p, int(e), s[e], int(c[e])) for p, (s, c) in enumerate(zip(sums, counts, strict=True)) for e in np.flatnonzero(c)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())], names=["part", "entry", "sums", "n"])

    found = trees.mapInArrow(run, "part int, entry int, sums array<long>, n long")
    total = F.array(*[F.sum(F.col("sums")[d]) for d in range(size)]) if size else F.array().cast("array<long>")
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(total.alias("sums"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry] = [s // r.n for s in r.sums]
    return out


def assigned(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, part, entry and squared distance."""
    size, kind, held = books[0].shape[1], books[0].dtype.type, trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, rows, tree = opened(batch, i, size, kind)
                book = held.value[part]
                nearest = tree.assign(book)[0]
                away = ((tree.points - book[nearest]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), part, np.int32)), pa.array(nearest.astype(np.int32)), pa.array(away.astype(np.int64))], names=["row", "part", "entry", "away"])

    return trees.mapInArrow(run, "row long, part int, entry int, away long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Id, code, error, label_error and codebooks_sha256 of every row that counts."""
    spark = rows.sparkSession
    found = written(kept(rows, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    limit = F.greatest(F.array_max("vector"), F.bitwise_not(F.array_min("vector")))
    n, least, width, limit = found.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector")), F.max(limit)).first()
    if n and (least != width or width % parts):
        raise ValueError(f"{vector_col} needs vectors of one length, which {parts} divides; found {least} to {width}")
    width, kind = width or 0, exact((limit or 0) + 1, width or 0)
    first = found.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.array([r.vector for r in first], kind).reshape(len(first), width)
    books = [start[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    trees = written(built(found, width, parts, kind, chunk), "vector-trees")
    for _ in range(rounds if n else 0):
        books = moved(trees, books)
    own = assigned(trees, books).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("codes"), F.sum("away").alias("error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c["entry"].cast("long"))), 2, "0")), "")
    coded = written(found.select("row", "id", "label", "spread").join(own.select("row", code.alias("code"), "error"), "row").withColumn("of", label_key("label")), "vector-codes")
    labels = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    out = hot_join(coded, labels, ["of"], "spread", "rows", "label-errors")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def label_key(name: str) -> Column:
    """Equal for equal labels, nulls together and apart from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))
