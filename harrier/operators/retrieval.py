"""Retrieval modes: dense, lexical, both fused, or whatever else is injected.

A retriever is a function of questions (query_id, query) that gives rankings (query_id, chunk, score, rank).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.operators import fusion, lexical, vector
from harrier.plans.config import DEFAULTS
from harrier.sources.shared import written

Retriever = Callable[[DataFrame], DataFrame]


def lexical_retriever(index: lexical.LexicalIndex, k: int = DEFAULTS.bm25_depth, allowed: DataFrame | None = None) -> Retriever:
    return lambda questions: lexical.search(index, questions, k, allowed=allowed)


def dense_retriever(points: DataFrame, vectors: DataFrame, k: int = DEFAULTS.dense_depth, id_col: str = "vec_id", vector_col: str = "embedding") -> Retriever:
    """vectors (query_id, query_vector) hold the embedding of each question; questions without one find nothing."""
    return lambda questions: vector.search(points, vectors.join(questions.select("query_id"), "query_id", "left_semi"), k, id_col, vector_col)


def retrieve(questions: DataFrame, mode: str, retrievers: Mapping[str, Retriever], weights: Mapping[str, float] | None = None, k: int = DEFAULTS.fused_depth) -> DataFrame:
    """query_id, chunk, score, rank, mode of the questions by a mode: the name of a retriever, or hybrid.

    hybrid fuses dense and bm25 by rank; if one of them is missing, the other alone decides.
    """
    if mode != "hybrid":
        if mode not in retrievers:
            raise ValueError(f"no retriever for mode {mode}; known are {', '.join(sorted(retrievers))} and hybrid")
        found = retrievers[mode](questions).filter(F.col("rank") <= k)
        return found.select("query_id", "chunk", "score", "rank", F.lit(mode).alias("mode"))
    both = {name: retrievers[name](questions) for name in ("dense", "bm25") if name in retrievers}
    if not both:
        raise ValueError("hybrid needs a dense or a bm25 retriever")
    fused = fusion.fuse(both, weights, limit=k)
    return fused.select("query_id", "chunk", F.col("rrf_score").alias("score"), "rank", F.lit(mode).alias("mode"))


def in_time(spark: SparkSession, jobs: Mapping[str, Callable[[], DataFrame]], limits: Mapping[str, float]) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables that ran within their limits (seconds; none: no limit), and the names of the others.

    All jobs start at once, each in a thread and under a tag of its own, and are written to the shared folder, so what
    is returned is done. A job over its limit is cancelled by its tag. A TimeoutError of a job counts as its limit
    passed; any other error is raised, once all jobs have ended.
    """
    context, tags = spark.sparkContext, {name: f"harrier-{uuid.uuid4().hex}" for name in jobs}

    def run(name: str) -> DataFrame:
        context.addJobTag(tags[name])
        return written(jobs[name](), f"branch-{name}")

    threads, start = ThreadPoolExecutor(max(1, len(jobs))), time.monotonic()
    running = {name: threads.submit(inheritable_thread_target(spark)(run), name) for name in jobs}
    done: dict[str, DataFrame] = {}
    late: list[str] = []
    errors: list[Exception] = []
    for name, job in running.items():
        left = None if name not in limits else max(0.0, start + limits[name] - time.monotonic())
        try:
            done[name] = job.result(left)
        except TimeoutError:
            context.cancelJobsWithTag(tags[name])
            late.append(name)
        except Exception as error:  # noqa: BLE001
            errors.append(error)
    threads.shutdown(wait=False)
    if errors:
        raise errors[0]
    return done, late


def retrieve_surviving(questions: DataFrame, retrievers: Mapping[str, Retriever], limits: Mapping[str, float], weights: Mapping[str, float] | None = None, k: int = DEFAULTS.fused_depth, fuse: Callable[..., DataFrame] = fusion.fuse) -> DataFrame:
    """query_id, chunk, score, rank, degraded: all retrievers fused by rank, without those that passed their limit.

    limits are seconds by the name of a retriever, or ``fusion``; degraded lists what passed its limit. If the fusion
    did, the first ranking that is there stands alone; if every retriever did, no row is left.
    """
    spark = questions.sparkSession
    found, late = in_time(spark, {name: (lambda r=r: r(questions)) for name, r in retrievers.items()}, limits)
    if not found:
        kind = questions.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, chunk long, score double, rank int, degraded array<string>")
    fused, slow = in_time(spark, {"fusion": lambda: fuse(found, weights, limit=k).withColumnRenamed("rrf_score", "score")}, limits)
    rows = fused.get("fusion", next(iter(found.values())).filter(F.col("rank") <= k))
    degraded = F.array(*[F.lit(name) for name in late + slow]).cast("array<string>")
    return rows.select("query_id", "chunk", "score", "rank", degraded.alias("degraded"))


def retrieve_variants(variants: DataFrame, mode: str, retrievers: Mapping[str, Retriever], weights: Mapping[str, float] | None = None, k: int = DEFAULTS.fused_depth) -> DataFrame:
    """The hits of all variants (see fusion.variants) of each question at once, tagged: query_id, technique, chunk, score,
    rank, pos (variant, then rank) and matched_queries, as fusion.dedup_best takes them."""
    keyed = variants.withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), "variant_order"))
    found = retrieve(keyed.select(F.col("key").alias("query_id"), "query"), mode, retrievers, weights, k).withColumnRenamed("query_id", "key")
    tagged = found.join(keyed.select("key", "query_id", "variant_order", "technique"), "key")
    return tagged.select("query_id", "technique", "chunk", "score", "rank", (F.col("variant_order") * 1_000_000 + F.col("rank")).alias("pos"), F.array("technique").alias("matched_queries"))
