"""Exact cosine search of a set of query vectors, with payload filters applied before any arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harrier.operators.lexical import top_k
from harrier.plans.config import DEFAULTS
from harrier.sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


#: Vectors of a packed block of points, and of queries; bytes of queries that are broadcast at once; centres at most.
BLOCK, QUERY_BYTES, CENTRES = 1_024, 32_000_000, 1_024
#: Points of so few blocks are compared at once.
WHOLE = 64


def units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and unit vectors of a column of lists, by length. Vectors without length are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        data = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        length = np.sqrt((data * data).sum(1))
        fine = np.flatnonzero(length > 0)  # nulls among the numbers make the length no number
        yield dim, at[fine], data[fine] / length[fine, None]


def _packed(rows: DataFrame, same: str | None = None) -> DataFrame:
    """id, vector -> blocks of unit vectors: ids, data (binary), dim, centre (binary) and radius, which hold all of them.

    Rows that differ in the column ``same`` are not packed together; those that agree must follow each other.
    """
    kind = rows.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [0, batch.num_rows]
            if same is not None and batch.num_rows:
                of = batch.column(2).to_numpy(zero_copy_only=False)
                cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), batch.num_rows]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                for i in range(a, z, BLOCK):
                    part = batch.slice(i, min(BLOCK, z - i))
                    for dim, at, unit in units(part.column(1)):
                        ids = part.column(0).take(pa.array(at))
                        centre = unit.mean(0) if len(unit) else np.zeros(dim)
                        radius = float(np.sqrt(((unit - centre) ** 2).sum(1).max(initial=0.0)))
                        listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
                        yield pa.RecordBatch.from_arrays([listed, pa.array([unit.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["ids", "data", "dim", "centre", "radius"])

    return rows.mapInArrow(pack, f"ids array<{kind.simpleString()}>, data binary, dim int, centre binary, radius double")


def clustered(points: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Blocks of points that lie near each other, for ``search_blocks``: block (a number), and as ``_packed``.

    Each point goes to the nearest of at most ``CENTRES`` points, those of least hash. What a block holds is told by its
    own centre and radius. A centre of very many points, as copies have, is dealt over groups by their count.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = rows.count()
    first = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(min(CENTRES, int(np.ceil(np.sqrt(n))) or 1)).select("v").toArrow()
    centres = {dim: unit for dim, _, unit in units(first["v"].combine_chunks())} if n else {}
    held = points.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.zeros(batch.num_rows, np.int64)
            for dim, at, unit in units(batch.column(1)):
                if dim in held.value and len(at):
                    best[at] = (unit @ held.value[dim].T).argmax(1) + dim * CENTRES
            yield batch.append_column("near", pa.array(best))

    kind = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    told = written(rows.mapInArrow(near, f"id {kind[0]}, v {kind[1]}, near long"), "near")
    groups = told.groupBy("near").agg(F.ceil(F.count("*") / (16 * block)).alias("groups"))  # a row for each centre and length
    dealt = told.join(F.broadcast(groups), "near").withColumn("of", F.hash("near", F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("groups"))))
    packed = _packed(dealt.repartition("of").sortWithinPartitions("of").select("id", "v", "of"), "of")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


class _Queries:
    """Parts of a set of queries, each of unit vectors by length that may be broadcast; ids by number."""

    def __init__(self, queries: DataFrame, query_id: str, query_vector: str):
        rows = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("v"))
        self.kind = rows.schema["id"].dataType.simpleString()
        self.packed = written(_packed(rows).select("ids", "data", "dim").withColumn("number", F.monotonically_increasing_id()), "query-blocks")
        size = self.packed.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        self.parts = max(1, -(-size // QUERY_BYTES))

    def part(self, k: int) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """By length: ids and vectors of one part, of a counted size."""
        own: dict[int, list] = {}
        for r in self.packed.filter(F.pmod(F.xxhash64("number"), F.lit(self.parts)) == k).toArrow().to_pylist():
            own.setdefault(r["dim"], []).append((r["ids"], np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"])))
        ids = self.packed.schema["ids"].dataType.elementType
        kind = to_arrow_type(ids)
        return {dim: (pa.array([i for x, _ in held for i in x], kind), np.concatenate([v for _, v in held])) for dim, held in own.items()}


def _scored(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, points and scores of the best k of each query; ties with the last one stay."""
    scores = np.round(q @ p.T, 9)
    least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else scores.min(1, initial=np.inf)
    which, at = np.nonzero(scores >= least[:, None])
    return which, at, scores[which, at]


def _compared(blocks: DataFrame, asked: dict[int, tuple[pa.Array, np.ndarray]], k: int, kinds: tuple[str, str]) -> DataFrame:
    """query_id, chunk, score: the best k of each block for each query, or for those whose numbers ``wants`` lists."""
    held = blocks.sparkSession.sparkContext.broadcast(asked)
    some = "wants" in blocks.columns

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(2)[i].as_py()
                if dim not in held.value:
                    continue
                ids, q = held.value[dim]
                chosen = np.array(batch.column(3)[i].as_py(), np.int64) if some else np.arange(len(ids))
                p = np.frombuffer(batch.column(1)[i].as_py(), np.float64).reshape(-1, dim)
                which, at, scores = _scored(q[chosen], p, k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(chosen[which])), batch.column(0)[i].values.take(pa.array(at)), pa.array(scores)], names=["query_id", "chunk", "score"])

    return blocks.select("ids", "data", "dim", *(["wants"] if some else [])).mapInArrow(best, f"query_id {kinds[1]}, chunk {kinds[0]}, score double")


def _bounds(blocks: DataFrame, asked: dict[int, tuple[pa.Array, np.ndarray]]) -> DataFrame:
    """block, dim, query (its number), bound: no point of the block has a higher score.

    A point at distance d from a query of length 1 scores 1 - d * d / 2, and d is at least the distance to the centre
    less the radius.
    """
    held = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, centre, radius in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if dim in held.value:
                    q = held.value[dim][1]
                    away = np.sqrt(((q - np.frombuffer(centre, np.float64)) ** 2).sum(1)) - radius
                    bound = 1 - np.maximum(away, 0) ** 2 / 2
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(np.full(len(q), dim, np.int32)), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(bound)], names=["block", "dim", "query", "bound"])

    return blocks.select("block", "dim", "centre", "radius").mapInArrow(run, "block long, dim int, query int, bound double")


def _passing(blocks: DataFrame, asked: dict[int, tuple[pa.Array, np.ndarray]], k: int, kinds: tuple[str, str]) -> DataFrame:
    """block, wants: the numbers of the queries that may find one of their best k in the block.

    The k-th best score in the block of the highest bound is a threshold that a block's bound must reach.
    """
    bounds = written(_bounds(blocks, asked), "bounds")
    first = top_k(bounds, ["dim", "query"], [F.col("bound").desc(), F.col("block")], 1).groupBy("block").agg(F.array_sort(F.collect_list("query")).alias("wants"))
    found = _compared(blocks.join(first, "block"), {d: (pa.array(np.arange(len(i), dtype=np.int32) + d * (1 << 20)), q) for d, (i, q) in asked.items()}, k, (kinds[0], "int"))
    best = top_k(found, ["query_id"], [F.col("score").desc(), F.col("chunk")], k).filter(F.col("rank") == k)
    least = best.select((F.col("query_id") / (1 << 20)).cast("int").alias("dim"), F.pmod("query_id", F.lit(1 << 20)).alias("query"), F.col("score").alias("least"))
    can = bounds.join(least, ["dim", "query"], "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8))
    return can.groupBy("block").agg(F.array_sort(F.collect_list("query")).alias("wants"))


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_depth, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, chunk, score, rank as ``search``, over ``clustered`` points: blocks that cannot matter are left out.

    Queries are broadcast in parts of counted size; each part meets the blocks where they lie.
    """
    asked, kinds = _Queries(queries, query_id, query_vector), [blocks.schema["ids"].dataType.elementType.simpleString()]
    few = blocks.count() <= WHOLE
    found = []
    for n in range(asked.parts):
        part = asked.part(n)
        own = blocks if few else blocks.join(_passing(blocks, part, k, (kinds[0], asked.kind)), "block")
        found.append(_compared(own, part, k, (kinds[0], asked.kind)))
    return top_k(reduce(DataFrame.unionByName, found), ["query_id"], [F.col("score").desc(), F.col("chunk")], k)


def share_compared(blocks: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_depth, query_id: str = "query_id", query_vector: str = "query_vector") -> float:
    """Pairs of a query and a block of its length that the second pass of a search compares, among all."""
    asked, kind = _Queries(queries, query_id, query_vector), blocks.schema["ids"].dataType.elementType.simpleString()
    met = every = 0
    for n in range(asked.parts):
        part = asked.part(n)
        every += _bounds(blocks, part).count()
        met += _passing(blocks, part, k, (kind, asked.kind)).agg(F.coalesce(F.sum(F.size("wants")), F.lit(0))).first()[0]
    return met / every if every else 0.0


def search(points: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_depth, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", where: Column | None = None) -> DataFrame:
    """query_id, chunk, score, rank: each query against every point that passes ``where``.

    Points are packed in blocks of unit vectors where they lie, and meet the queries, broadcast in parts of counted
    size; a matrix product gives a block's scores, of which each query's best k go on. Ties go by point id.
    ``clustered`` points can be searched by ``search_blocks`` again and again, without comparing all of them.
    """
    kept = points if where is None else points.filter(where)
    blocks = _packed(kept.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))
    asked, kind = _Queries(queries, query_id, query_vector), points.schema[id_col].dataType.simpleString()
    found = [_compared(blocks, asked.part(n), k, (kind, asked.kind)) for n in range(asked.parts)]
    return top_k(reduce(DataFrame.unionByName, found), ["query_id"], [F.col("score").desc(), F.col("chunk")], k)


def payload_filter(repository: Column | None = None, versions: Column | None = None, notes: Column | None = None, paths: Column | None = None) -> Column:
    """must(repository) and should(versions or notes) and any of paths; what is None does not restrict."""
    out = F.lit(True)
    if repository is not None:
        out = out & repository
    if versions is not None or notes is not None:
        out = out & (versions if notes is None else notes if versions is None else versions | notes)
    return out if paths is None else out & paths
