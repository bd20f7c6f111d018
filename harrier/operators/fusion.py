"""Rank fusion, multi-query retrieval and evidence dedup."""

from __future__ import annotations

from collections.abc import Sequence, Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators.lexical import top_k
from harrier.plans.config import DEFAULTS
from harrier.sources.shared import plain_unions


def fuse(rankings: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = DEFAULTS.rrf_k, limit: int | None = DEFAULTS.fused_depth) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, chunk, score, rank), in the order of the mapping.

    query_id, chunk, rrf_score, rank, retrieval_sources (in retriever order), ranks and scores by retriever. A chunk
    listed twice in a ranking counts once, at its first rank. Ties go to what was seen first: by retriever, then rank.
    """
    weights, parts = weights or {}, []
    for place, (name, ranking) in enumerate(rankings.items()):
        parts.append(ranking.select("query_id", "chunk", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(name).alias("retriever"), F.lit(place).alias("place"), F.lit(float(weights.get(name, 1.0))).alias("weight")))
    every = parts[0]
    plain_unions(every.sparkSession)
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.groupBy("query_id", "chunk", "place", "retriever", "weight").agg(F.min(F.struct("rank", "score")).alias("best"))
    one = F.struct("place", "retriever", F.col("best.rank").alias("rank"), F.col("best.score").alias("score"))
    fused = once.groupBy("query_id", "chunk").agg(F.round(F.sum(F.col("weight") / (k + F.col("best.rank"))), 9).alias("rrf_score"), F.min(F.struct("place", F.col("best.rank").alias("rank"))).alias("seen"), F.array_sort(F.collect_list(one)).alias("by"))
    ranked = top_k(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("seen"), F.col("chunk")], limit)
    return ranked.select("query_id", "chunk", "rrf_score", "rank", F.transform("by", lambda x: x["retriever"]).alias("retrieval_sources"), F.map_from_entries(F.transform("by", lambda x: F.struct(x["retriever"], x["rank"]))).alias("retrieval_ranks"), F.map_from_entries(F.transform("by", lambda x: F.struct(x["retriever"], x["score"]))).alias("retrieval_scores"))


def variants(queries: DataFrame, query_id: str, query_text: str, domain: str, most: int = DEFAULTS.max_variants, rewriting: bool = True, expansion: bool = True, reformulation: bool = True, extra: Mapping[str, Callable[[Column], Column]] | None = None, expand: Callable[[Column], Column] = X.expand) -> DataFrame:
    """query_id, variant_order, technique, query: the original and its transformations, without repeats but for case."""
    steps: dict[str, Column] = {"original": X.clean(F.col(query_text))}
    if rewriting:
        steps["rewritten"] = X.rewrite(F.col(query_text))
    if expansion:
        steps["keyword_expansion"] = expand(F.col(query_text))
    if reformulation:
        steps["domain_reformulation"] = X.reframe(F.col(query_text), domain)
    steps |= {name: make(F.col(query_text)) for name, make in (extra or {}).items()}
    listed = F.array(*[F.struct(F.lit(name).alias("technique"), made.alias("query")) for name, made in steps.items()])
    rows = queries.filter(X.clean(F.col(query_text)) != "").select(F.col(query_id).alias("query_id"), F.posexplode(listed).alias("pos", "v")).select("query_id", "pos", "v.*")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", F.lower("query")).orderBy("pos"))).filter("n = 1")
    return top_k(first, ["query_id"], [F.col("pos")], most, "variant_order").select("query_id", (F.col("variant_order") - 1).alias("variant_order"), "technique", "query")


def dedup_best(results: DataFrame, identity: list[str], by: list[str], score: str = "score", pos: str = "pos", tags: str = "matched_queries") -> DataFrame:
    """One row for each identity in each group: the payload of the strictly best score (first on ties, nulls last).

    The place is that of the first occurrence; tags are the ordered union. Rows with an incomplete identity stay apart.
    """
    whole = F.lit(True)
    for c in identity:
        whole = whole & F.col(c).isNotNull()
    keyed = results.withColumn("__alone", F.when(~whole, F.col(pos)))
    part = W.partitionBy(*by, *identity, "__alone")
    ranked = keyed.withColumn("__n", F.row_number().over(part.orderBy(F.col(score).desc_nulls_last(), F.col(pos)))).withColumn("__first", F.min(pos).over(part))
    listed = F.collect_list(F.struct(F.col(pos).alias("p"), F.col(tags).alias("t"))).over(part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    union = F.array_distinct(F.flatten(F.transform(F.array_sort(listed), lambda x: x["t"])))
    return ranked.withColumn(tags, union).filter("__n = 1").withColumn(pos, F.col("__first")).drop("__n", "__first", "__alone")


def overlap(left: DataFrame, right: DataFrame, by: str = "query_id", key: str = "chunk") -> DataFrame:
    """Per group: left_only, right_only, both, union_count, overlap_ratio of two result sets."""
    flags = left.select(by, key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(by, key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = flags.groupBy(by, key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.groupBy(by).agg(F.sum(F.expr("l * (1 - r)")).alias("left_only"), F.sum(F.expr("r * (1 - l)")).alias("right_only"), F.sum(F.expr("l * r")).alias("both"), F.count("*").alias("union_count"), F.round(F.sum(F.expr("l * r")) / F.count("*"), 6).alias("overlap_ratio"))


def merged_maps(rows: DataFrame, by: Sequence[str], ranks: str, scores: str) -> DataFrame:
    """by, and two maps: the least rank and the largest score of each retriever over the maps of a group's rows."""
    single = rows.select(*by, F.explode_outer(F.map_keys(F.map_concat(F.transform_values(ranks, lambda _, v: v.cast("double")), F.map_filter(F.transform_values(scores, lambda _, v: v.cast("double")), lambda k, _: ~F.map_contains_key(ranks, k))))).alias("retriever"), ranks, scores)
    single = single.select(*by, "retriever", F.try_element_at(ranks, "retriever").alias("rank"), F.try_element_at(scores, "retriever").alias("score"))
    best = single.groupBy(*by, "retriever").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("retriever").isNotNull() & F.col(value).isNotNull(), F.struct("retriever", value)))))
    return best.groupBy(*by).agg(entry("rank").alias(ranks), entry("score").alias(scores))
