"""Reranking, evidence selection, evidence quality and answer status."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.plans.config import DEFAULTS

#: What marks a question about live data, and words that do not count as support.
LIVE = (r"\b(?:now|latest|current(?:ly)?|today(?:'s)?|tomorrow(?:'s)?|live|real[- ]?time)\b",)
LIVE_DOMAINS = (
    r"\b(?:weather|forecast)\b",
    r"\b(?:share|stock)\s+price\b",
    r"\bipl\b.*\b(?:score|match|fixture|result)\b",
    r"\b(?:score|match|fixture|result)\b.*\bipl\b",
    r"\bcafeteria\b.*\bmenu\b",
    r"\bmenu\b.*\bcafeteria\b",
    r"\bnetwork\s+topology\b",
)
STOP_WORDS = ("a", "an", "and", "are", "at", "be", "do", "does", "for", "from", "how", "in", "is", "it", "me", "of", "on", "please", "show", "tell", "the", "to", "what", "when", "which", "who", "will", "with", "now", "latest", "current", "currently", "today", "tomorrow", "live")


def rerank(candidates: DataFrame, scorer: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """candidates with reranker_score, rerank_rank and rank_shift. Order: score, then original rank; nothing is lost."""
    w = W.partitionBy(by).orderBy(F.col("reranker_score").desc_nulls_last(), F.col(rank))
    return candidates.withColumn("reranker_score", scorer).withColumn("rerank_rank", F.row_number().over(w)).withColumn("rank_shift", F.col(rank) - F.col("rerank_rank"))


#: Models that this process has loaded, by the name of their loading.
_LOADED: dict[str, Callable] = {}


def rerank_by_model(candidates: DataFrame, load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], query: str = "query", text: str = "text", by: str = "query_id", rank: str = "rank", batch: int = 64) -> DataFrame:
    """``rerank`` by a model of (queries, texts), which ``load`` gives.

    A worker loads the model once and keeps it for all tasks it gets of this call; pairs are scored in batches of at
    most ``batch``. Null queries and texts are empty ones. A model that gives another number of scores, or fails, fails
    the job; a score that is no number counts as none.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from harrier.operators.evidence import _LOADED as held  # the worker's own, not a copy sent along

        model = held.get(name)
        if model is None:
            held.clear()  # a model of an earlier call gives way
            model = held[name] = load()
        for queries, texts in parts:
            q, t, out = queries.fillna("").tolist(), texts.fillna("").tolist(), []
            for k in range(0, len(q), batch):
                scores = list(model(q[k : k + batch], t[k : k + batch]))
                if len(scores) != len(q[k : k + batch]):
                    raise ValueError("the model gave another number of scores")
                out += [None if s is None or s != s else float(s) for s in scores]
            yield pd.Series(out, dtype="float64")

    scored = candidates.withColumn("__score", score(F.col(query).cast("string"), F.col(text).cast("string")))
    return rerank(scored, F.nanvl("__score", F.lit(None).cast("double")), by, rank).drop("__score")


def passthrough(rrf: Column, score: Column) -> Column:
    return F.coalesce(rrf, score)


@dataclass(frozen=True)
class Selection:
    threshold: float = DEFAULTS.score_threshold
    min_selected: int = DEFAULTS.min_selected
    max_selected: int = DEFAULTS.max_selected
    per_source: int = DEFAULTS.per_source
    redundancy: float | None = DEFAULTS.redundancy
    budget: int = DEFAULTS.token_budget
    target_min: int = DEFAULTS.target_min
    target_max: int = DEFAULTS.target_max
    fallback: bool = True
    fallback_n: int = DEFAULTS.min_selected


#: What a fold over the pool of a query knows: the rows chosen so far, in order, and their tokens.
CHOSEN = "struct<rows:array<struct<rank:int,source:{source},why:string>>,tokens:bigint>"


class _Fold:
    """Conditions on a row of the pool, given what is chosen; each rule of the selection is one of these."""

    def __init__(self, how: Selection, floor: Column, state: Column, row: Column):
        self.how, self.state, self.row = how, state, row
        self.short = F.size(state["rows"]) < floor
        self.room = F.size(state["rows"]) < how.max_selected

    def known(self) -> Column:
        """The same chunk, or a chosen one of nearly the same words, is chosen already."""
        return F.arrays_overlap(F.transform(self.state["rows"], lambda c: c["rank"]), self.row["like"])

    def crowded(self) -> Column:
        return F.size(F.filter(self.state["rows"], lambda c: c["source"].eqNullSafe(self.row["source"]))) >= self.how.per_source

    def within(self, limit: int) -> Column:
        return self.state["tokens"] + self.row["tokens"] <= limit

    def enough(self) -> Column:
        return ~self.short & (self.state["tokens"] >= self.how.target_min)

    def passes(self) -> Column:
        """A row of the first pass: above the threshold, new, of a source with room, within the budget."""
        done = self.enough() if self.how.target_min else F.lit(False)
        return self.room & (self.row["score"] >= self.how.threshold) & ~self.known() & ~self.crowded() & self.within(self.how.budget) & ~done & (self.short | self.within(self.how.target_max))

    def fills(self, strict: bool) -> Column:
        """A row that fills up to the floor and the least tokens; strict: new, and of a source with room."""
        free = ~F.exists(self.state["rows"], lambda c: c["rank"] == self.row["rank"])
        fits = self.short | self.within(min(self.how.budget, self.how.target_max))
        return self.room & ~self.enough() & free & fits & (~self.known() & ~self.crowded() if strict else F.lit(True))

    def with_row(self, why: str) -> Column:
        row = F.struct(self.row["rank"].alias("rank"), self.row["source"].alias("source"), F.lit(why).alias("why"))
        return F.struct(F.array_append(self.state["rows"], row).alias("rows"), (self.state["tokens"] + self.row["tokens"]).alias("tokens"))


def alike(pools: DataFrame, least: float | None) -> DataFrame:
    """pools (query_id, pool: array of rank, chunk, words, ...) with, for each row of a pool, the ranks of those it repeats.

    These are rows of the same chunk, and those whose words have a Jaccard similarity of ``least`` or more; one product
    of a pool's rows and words tells it for all pairs of the pool, which is bounded.
    """
    schema = pools.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for i in range(batch.num_rows):
                rows = batch.column(1)[i].values
                chunks, ranks = rows.field("chunk").to_pylist(), rows.field("rank").to_numpy()
                same = np.array([[a == b for b in chunks] for a in chunks], bool).reshape(len(rows), len(rows))
                if least is not None:
                    words = rows.field("words")
                    coded = pc.dictionary_encode(words.flatten())
                    has = np.zeros((len(rows), len(coded.dictionary)), np.float32)
                    has[np.repeat(np.arange(len(rows)), pc.list_value_length(words)), coded.indices.to_numpy()] = 1
                    both, size = has @ has.T, has.sum(1)
                    either = size[:, None] + size[None, :] - both
                    same |= np.where(either > 0, both.astype(float) / np.maximum(either, 1).astype(float), 1.0) >= least
                told.append([ranks[row].tolist() for row in same])
            yield batch.append_column("like", pa.array(told, pa.list_(pa.list_(pa.int32()))))

    return pools.mapInArrow(run, f"{schema}, like array<array<int>>")


def select_evidence(candidates: DataFrame, how: Selection = Selection()) -> DataFrame:
    """candidates (query_id, chunk, text, source, reranker_score, rerank_rank) -> a decision for each row.

    The pool of a query is bounded by the rerank pool before it gets here; it is folded in reranked order, once for
    rows that pass, once to fill up to the floor, and once more without the limits on repeats if that did not do.
    """
    kinds = dict(candidates.dtypes)
    tokens = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.NON_SPACE), F.lit(0)))
    score = F.coalesce(F.nanvl(F.col("reranker_score").cast("double"), F.lit(0.0)), F.lit(0.0))
    row = F.struct(F.col("rerank_rank").cast("int").alias("rank"), "chunk", "source", score.alias("score"), tokens.alias("tokens"), X.word_set(F.col("text")).alias("words"))
    pools = alike(candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("pool")), how.redundancy)
    pools = pools.withColumn("pool", F.transform("pool", lambda r, i: F.struct(r["rank"].alias("rank"), r["chunk"].alias("chunk"), r["source"].alias("source"), r["score"].alias("score"), r["tokens"].alias("tokens"), F.col("like")[i].alias("like"))))
    usable = F.filter("pool", lambda r: r["tokens"] > 0)
    floor = F.least(F.lit(how.min_selected), F.size("usable"), F.lit(how.max_selected))
    if how.fallback:
        none = ~F.exists("usable", lambda r: r["score"] >= how.threshold)
        floor = F.when(none, F.least(F.greatest(floor, F.lit(how.fallback_n)), F.size("usable"), F.lit(how.max_selected))).otherwise(floor)
    pools = pools.withColumn("usable", usable).withColumn("floor", floor)

    def folded(start: Column, test: str, why: str, **options: bool) -> Column:
        def step(state: Column, row: Column) -> Column:
            at = _Fold(how, F.col("floor"), state, row)
            return F.when(getattr(at, test)(**options), at.with_row(why)).otherwise(state)

        return F.aggregate("usable", start, step)

    nothing = F.struct(F.array().alias("rows"), F.lit(0).cast("bigint").alias("tokens")).cast(CHOSEN.format(**kinds))
    pools = pools.withColumn("chosen", folded(nothing, "passes", "threshold_pass"))
    if how.fallback:
        pools = pools.withColumn("chosen", folded(F.col("chosen"), "fills", "adaptive_fallback", strict=True))
        pools = pools.withColumn("chosen", F.when(F.size("chosen.rows") < F.col("floor"), folded(F.col("chosen"), "fills", "adaptive_fallback", strict=False)).otherwise(F.col("chosen")))
    rows = pools.select("query_id", "floor", "chosen", F.explode("pool").alias("r"))
    at, place = _Fold(how, F.col("floor"), F.col("chosen"), F.col("r")), F.array_position(F.transform("chosen.rows", lambda c: c["rank"]), F.col("r.rank"))
    rejected = (
        F.when(F.col("r.tokens") == 0, "empty_text")
        .when(F.col("r.score") < how.threshold, "threshold_failed")
        .when(at.known(), "redundancy")
        .when(at.crowded(), "source_diversity_limit")
        .when(~at.within(min(how.budget, how.target_max)), "token_budget")
        .otherwise("lower_rank_fallback")
    )
    selected = place > 0
    why = F.when(selected, F.get(F.col("chosen.rows"), place - 1)["why"])
    return rows.select("query_id", F.col("r.chunk").alias("chunk"), F.col("r.rank").alias("rerank_rank"), selected.alias("selected"), F.when(selected, place.cast("int")).alias("selected_order"), why.alias("selection_reason"), F.when(~selected, rejected).alias("discard_reason"), F.col("r.tokens").alias("tokens"), (F.col("r.score") < how.threshold).alias("weak_evidence"))


def strength(score: Column, strong: float = DEFAULTS.strong, medium: float = DEFAULTS.medium) -> Column:
    return F.when(score >= strong, "strong").when(score >= medium, "medium").otherwise("weak")


def provenance(dense: Column, lexical: Column) -> Column:
    return F.when(dense & lexical, "both").when(dense, "dense").when(lexical, "bm25").otherwise("unknown")


def quality_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of rows (score, source, page, strength, provenance): counts, averages, diversity, distributions."""
    n = F.count("*")
    counts = [F.count_if(F.col("strength") == s).alias(f"{s}_count") for s in ("strong", "medium", "weak")] + [F.count_if(F.col("provenance") == p).alias(f"{p}_count") for p in ("dense", "bm25", "both")]
    return rows.groupBy(*by).agg(n.alias("chunk_count"), F.round(F.avg("score"), 6).alias("average_score"), F.round(F.min("score"), 6).alias("minimum_score"), F.round(F.max("score"), 6).alias("maximum_score"), F.count_distinct("source").alias("unique_sources"), F.round(F.count_distinct("source") / n, 6).alias("diversity_ratio"), *counts)


def confidence(n: Column, strong: Column, weak: Column) -> Column:
    return F.when(n == 0, "none").when(strong == n, "strong").when(weak == n, "weak").otherwise("mixed")


def sufficient(best: Column, mean: Column, confidence: Column, all_fallback: Column, all_weak: Column, medium: float = DEFAULTS.medium) -> Column:
    return (best >= medium) & (mean >= medium) & confidence.isin("strong", "mixed") & ~all_fallback & ~all_weak


def is_live(question: Column) -> Column:
    return question.rlike("(?i)" + "|".join((*LIVE, *LIVE_DOMAINS)))


def supported(question_terms: Column, evidence_terms: Column) -> Column:
    """At least two question terms (or all, if fewer) stand in the evidence; stop words do not count."""
    wanted = F.array_except(F.array_distinct(question_terms), F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.size(F.array_intersect(wanted, evidence_terms)) >= F.least(F.lit(2), F.size(wanted))


def final_status(n: Column, live: Column, support: Column, confidence: Column, enough: Column) -> Column:
    return F.when(live & ~support, "unsupported").when(n == 0, "insufficient_evidence").when(enough, "answered").when(confidence == "weak", "extractive_fallback").otherwise("answered_with_caution")
