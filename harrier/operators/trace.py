"""Traces of a question: diagnostics, chunk statistics and the nested record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import relations
from harrier.plans.config import DEFAULTS


def diagnostics(medium: float = DEFAULTS.medium) -> Column:
    """Signals of a row of metrics: reduction (percent), average_score, selected, candidates, selected_tokens, status,
    redundant (discards), generation, reranking, retrieval (seconds), sources."""
    c = F.col
    answered = F.lower(c("status")) == "answered"
    return F.array_compact(
        F.array(
            F.when((c("candidates") > 0) & (c("selected") == 0), "evidence_starvation"),
            F.when(c("reduction") > 90, "excessive_token_reduction").otherwise("token_reduction"),
            F.when(answered & c("selected_tokens").between(1, 499), "low_selected_evidence_tokens"),
            F.when((c("candidates") > 0) & (c("average_score") == 0), "zero_average_reranker_score"),
            F.when((c("selected") > 0) & (c("average_score") < medium), "evidence_strength"),
            F.when(c("redundant") >= 2, "redundancy"),
            F.when(c("generation") > F.greatest(F.lit(0.001), c("retrieval") + c("reranking")), "generation_latency"),
            F.when((c("selected") > 0) & (c("sources") <= 1), "source_diversity"),
            F.when(c("reranking") > F.greatest(F.lit(0.001), c("retrieval")), "reranker_latency"),
        )
    )


def chunk_stats(chunks: DataFrame, size: str, source: str) -> DataFrame:
    """One row: chunk_count, min, max and average characters (one place), sources; zeros for no chunks."""
    zero = F.lit(0)
    return chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.min(size), zero).alias("min_chars"), F.coalesce(F.max(size), zero).alias("max_chars"), F.coalesce(F.round(F.avg(size), 1), F.lit(0.0)).alias("avg_chars"), F.count_distinct(source).alias("sources"))


def question_trace(stages: DataFrame, by: str = "query_id", version: str = "trace-v1") -> DataFrame:
    """stages (by, stage, chunk, rank, score) -> one row for each question: schema_version and a map of ordered stages."""
    one = F.struct("rank", "chunk", "score")
    listed = stages.groupBy(by, "stage").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return listed.groupBy(by).agg(F.lit(version).alias("schema_version"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "rows")))).alias("stages"))


def retrieval_diagnostics() -> Column:
    """(signal, state) of a row of retrieval metrics: utilization (percent), final_only_bm25 and final_bm25 (chunks),
    overlap_ratio (null: nothing retrieved), generation, retrieval (seconds), sources, final (chunks)."""
    c = F.col
    signals = {
        "token_budget": F.when(c("utilization") > 95, "tight").otherwise("fine"),
        "bm25_value": F.when(c("final_only_bm25") > 0, "unique").when(c("final_bm25") > 0, "agreed").otherwise("none"),
        "retriever_agreement": F.when(F.coalesce("overlap_ratio", F.lit(1.0)) < 0.25, "low").otherwise("fine"),
        "latency": F.when(c("generation") > F.greatest(F.lit(0.001), 2 * c("retrieval")), "generation").otherwise("fine"),
        "source_diversity": F.when((c("sources") <= 1) & (c("final") > 0), "concentrated").otherwise("fine"),
    }
    return F.array(*[F.struct(F.lit(name).alias("signal"), state.alias("state")) for name, state in signals.items()])


#: What a trace tells of a chunk in a ranking or a stage; what its table lacks is null.
RECORD = {"rank": "int", "source": "string", "page": "string", "chunk": "string", "score": "double", "retrieval_sources": "array<string>", "variant": "string", "reason": "string", "is_neighbor": "boolean", "truncated": "boolean"}
#: The stages that a context runs through, and the characters of a preview.
CONTEXT_STAGES = ("retrieved", "deduplicated", "expanded", "merged", "compressed")
PREVIEW = 500


def _records(rows: DataFrame, part: str, by: str) -> DataFrame:
    cells = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items()]
    text = F.col("text") if "text" in rows.columns else F.lit(None).cast("string")
    flat = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, PREVIEW)
    return rows.select(by, F.lit(part).alias("part"), *cells, F.coalesce(X.token_estimate(text), F.lit(0)).cast("long").alias("tokens"), flat.alias("preview"))


def whole_trace(questions: DataFrame, rankings: Mapping[str, DataFrame], stages: Mapping[str, DataFrame], evidence: DataFrame | None = None, timings: DataFrame | None = None, budget: int = DEFAULTS.context_tokens, by: str = "query_id", version: str = "trace-v2") -> DataFrame:
    """One row for each question (by, query): everything that its trace tells, as nested columns.

    rankings are dense, bm25 and fused hits; stages are the rows after each of CONTEXT_STAGES; evidence is what
    evidence.select_evidence gives; timings holds by, retrieval, context and generation in seconds (absent: zeros).
    A chunk is told by source, page and chunk. A question without any hit has empty lists, zeros and an overlap ratio of
    null. All parts meet in one grouping by question; its rows are bounded by the depths of rankings and stages.
    """
    parts = {**rankings, **stages}
    if evidence is not None:
        chosen = evidence.withColumn("reason", F.coalesce("selection_reason", "discard_reason")).withColumn("rank", F.col("rerank_rank"))
        parts |= {"selected": chosen.filter("selected"), "discarded": chosen.filter("NOT selected")}
    known = ["dense", "bm25", "fused", *CONTEXT_STAGES, "selected", "discarded"]
    if odd := sorted(set(parts) - set(known)):
        raise ValueError(f"a trace has no part {', '.join(odd)}")
    every = relations.stacked([_records(rows, name, by) for name, rows in parts.items()])
    fields = ["part", *RECORD, "tokens", "preview"]
    grouped = every.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    asked = questions.select(by, "query").join(grouped, by, "left")
    listed = asked.withColumn("all", F.coalesce("all", F.array().cast(grouped.schema["all"].dataType)))
    one = F.struct(*[F.lit(None).cast(kind).alias(c) for c, kind in RECORD.items()], F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("string").alias("preview"))
    bare = lambda name: F.transform(F.filter("all", lambda x: x["part"] == name), lambda x: F.struct(*[x[c].alias(c) for c in fields[1:]]))
    listed = listed.withColumns({name: bare(name) if name in parts else F.slice(F.array(one), 1, 0) for name in known})
    c = F.col
    ids = lambda name: F.array_distinct(F.transform(name, lambda x: F.to_json(F.struct(x["source"], x["page"], x["chunk"]))))
    listed = listed.drop("all").withColumns({"__d": ids("dense"), "__b": ids("bm25")})
    size = lambda name: F.size(name).cast("long")
    tokens = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    has = lambda x, name: F.array_contains(F.coalesce(x["retrieval_sources"], F.array().cast("array<string>")), name)
    met = listed.withColumns({
        "__both": F.size(F.array_intersect("__d", "__b")).cast("long"),
        "__union": F.size(F.array_union("__d", "__b")).cast("long"),
        "__used": tokens("compressed"),
        "__sources": F.array_sort(F.array_distinct(F.array_compact(F.transform("compressed", lambda x: x["source"])))),
        "__pages": F.array_distinct(F.array_compact(F.transform("compressed", lambda x: F.when(x["page"] != "", F.to_json(F.struct(x["source"], x["page"])))))),
    })
    if timings is None:
        met = met.withColumns({name: F.lit(0.0) for name in ("retrieval", "context", "generation")})
    else:
        met = met.join(timings.select(by, "retrieval", "context", "generation"), by, "left").fillna(0.0, ["retrieval", "context", "generation"])
    met = met.withColumns({
        "utilization": F.round(100 * c("__used") / budget, 2) if budget else F.lit(0.0),
        "overlap_ratio": F.when(c("__union") > 0, F.round(c("__both") / c("__union"), 6)),
        "final_bm25": F.size(F.filter("compressed", lambda x: has(x, "bm25"))),
        "final_only_bm25": F.size(F.filter("compressed", lambda x: has(x, "bm25") & ~has(x, "dense"))),
        "sources": F.size("__sources"),
        "final": F.size("compressed"),
    })
    counts = {"dense_raw": size("dense"), "bm25_raw": size("bm25"), "combined": size("dense") + size("bm25"), "fused": size("fused"), **{s: size(s) for s in CONTEXT_STAGES}}
    reasons = F.array_distinct(F.transform("discarded", lambda x: x["reason"]))
    lost = F.map_from_entries(F.transform(reasons, lambda r: F.struct(r.alias("key"), F.size(F.filter("discarded", lambda x: x["reason"].eqNullSafe(r))).alias("value"))))
    table = lambda cells: F.create_map(*[x for name, v in cells.items() for x in (F.lit(name), v)])
    return met.select(
        by, c("query").alias("question"), F.lit(version).alias("schema_version"),
        F.struct((size("__d") - c("__both")).alias("dense_only"), (size("__b") - c("__both")).alias("bm25_only"), c("__both").alias("both"), c("__union").alias("union_count"), "overlap_ratio").alias("overlap"),
        F.struct(size("retrieved").alias("before"), size("deduplicated").alias("after"), F.greatest(F.lit(0), size("retrieved") - size("deduplicated")).alias("removed")).alias("deduplication"),
        F.struct(size("deduplicated").alias("original"), F.size(F.filter("expanded", lambda x: F.coalesce(x["is_neighbor"], F.lit(False)))).cast("long").alias("added"), size("expanded").alias("total")).alias("neighbor_expansion"),
        F.struct(table(counts).alias("counts"), table({s: tokens(s) for s in CONTEXT_STAGES}).alias("tokens")).alias("funnel"),
        F.struct(F.lit(budget).cast("long").alias("budget"), c("__used").alias("used"), F.greatest(F.lit(0), budget - c("__used")).alias("remaining"), size("compressed").alias("included"), (size("merged") - size("compressed")).alias("skipped"), "utilization").alias("token_usage"),
        F.struct(size("selected").alias("selected"), size("discarded").alias("discarded"), lost.alias("reasons"), tokens("selected").alias("tokens")).alias("evidence"),
        F.struct(size("__sources").alias("sources"), size("__pages").alias("pages"), c("__sources").alias("names")).alias("source_diversity"),
        F.struct("retrieval", "context", "generation", F.round(c("retrieval") + c("context") + c("generation"), 6).alias("total")).alias("latency"),
        retrieval_diagnostics().alias("signals"),
        table({name: c(name) for name in known}).alias("records"),
    )


def trace_json(traces: DataFrame, by: str = "query_id") -> DataFrame:
    """by and the trace as JSON, nulls included; read back with the schema of ``traces`` it is the same trace."""
    return traces.select(by, F.to_json(F.struct(*traces.columns), {"ignoreNullFields": "false"}).alias("trace"))
