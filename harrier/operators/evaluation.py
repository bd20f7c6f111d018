"""Answer evaluation, experiment aggregates and rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a safe failure says.
SAFE_FAILURE = ("insufficient evidence", "do not contain sufficient", "could not find enough evidence", "no reliable answer", "cannot answer from", "not available in the")
#: What an answer must not say, and what tells that evidence was missing.
FORBIDDEN = ("as an ai", "i cannot access", "according to my knowledge")
INSUFFICIENT = ("insufficient evidence", "no reliable answer", "cannot be answered")
WEIGHTS = {"accuracy": 0.55, "citation": 0.15, "safety": 0.2, "latency": 0.1}


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def evaluate(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows (answer, status, should_answer, expected, forbidden, citations; arrays of strings) with the verdict columns.

    No citations given: the distinct [n] marks of the answer count. Citations without a source (empty) are incomplete.
    """
    answer = normal(F.col("answer"))
    holds = lambda words: F.size(F.filter(words, lambda k: F.contains(answer, normal(k))))
    expected = F.size("expected")
    score = F.when(expected > 0, holds(F.col("expected")) / expected).otherwise((answer != "").cast("double"))
    status = F.replace(normal(F.col("status")), F.lit(" "), F.lit("_"))
    safe = status.isin("insufficient_evidence", "safe_failure")
    for marker in SAFE_FAILURE:
        safe = safe | answer.contains(marker)
    marks = F.size(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))))
    given = F.size("citations")
    count = F.when(given > 0, given).otherwise(marks)
    quality = F.when(given > 0, F.size(F.filter("citations", lambda c: c != "")) / given).when(marks > 0, 1.0).otherwise(0.0)
    bad = holds(F.col("forbidden"))
    return (
        rows.withColumn("keyword_score", F.round(score, 6))
        .withColumn("matched_keywords", holds(F.col("expected")))
        .withColumn("forbidden_keyword_matches", bad)
        .withColumn("safe_failure", safe)
        .withColumn("passed", F.when(F.col("should_answer"), (answer != "") & ~safe & (score >= threshold)).otherwise(safe & (bad == 0)))
        .withColumn("hallucinated", F.when(F.col("should_answer"), bad > 0).otherwise((answer != "") & ~safe))
        .withColumn("citation_count", count)
        .withColumn("citation_quality", F.round(quality, 6))
    )


def aggregate(rows: DataFrame, by: str = "experiment_id", averages: tuple[str, ...] = ("keyword_score", "citation_quality", "latency")) -> DataFrame:
    """One row for each experiment: question_count, accuracies, hallucination rate and averages (six places)."""
    rate = lambda test: F.round(F.coalesce(F.avg(test), F.lit(0.0)), 6)
    passed = F.col("passed").cast("double")
    return rows.groupBy(by).agg(
        F.count("*").alias("question_count"),
        rate(passed).alias("answer_accuracy"),
        rate(F.when(F.col("should_answer"), passed)).alias("supported_accuracy"),
        rate(F.when(~F.col("should_answer"), passed)).alias("unsupported_accuracy"),
        rate(F.col("hallucinated").cast("double")).alias("hallucination_rate"),
        *[F.round(F.avg(c), 6).alias(f"average_{c}") for c in averages],
    )


def pass_rates(rows: DataFrame, by: str = "experiment_id", parts: tuple[str, ...] = ("category", "difficulty")) -> DataFrame:
    """by, part, value, pass_rate: the pass rate by each of the parts, in one pass of grouping sets."""
    sets = rows.groupingSets([[F.col(by), F.col(p)] for p in parts], F.col(by), *[F.col(p) for p in parts]).agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), *[F.grouping(p).alias(f"__{p}") for p in parts])
    part = F.coalesce(*[F.when(F.col(f"__{p}") == 0, F.lit(p)) for p in parts])
    return sets.select(by, part.alias("part"), F.coalesce(*[F.when(F.col(f"__{p}") == 0, F.col(p)) for p in parts]).alias("value"), "pass_rate")


def rank(summary: DataFrame, by: str = "experiment_id") -> DataFrame:
    """summary with overall_score and place: accuracy, citation quality, safety and latency relative to the others."""
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    low, high = F.min("average_latency").over(every), F.max("average_latency").over(every)
    speed = F.when(high == low, 1.0).otherwise(1.0 - (F.col("average_latency") - low) / (high - low))
    score = WEIGHTS["accuracy"] * F.col("answer_accuracy") + WEIGHTS["citation"] * F.col("average_citation_quality") + WEIGHTS["safety"] * (1.0 - F.col("hallucination_rate")) + WEIGHTS["latency"] * speed
    scored = summary.withColumn("overall_score", F.round(score, 6))
    return scored.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("overall_score"), "average_latency", by)))


def best(ranked: DataFrame, by: str = "experiment_id") -> DataFrame:
    """One row: best, fastest and safest experiment, and the score gap of the best to the mean."""
    return ranked.agg(F.min_by(by, "place").alias("best"), F.min_by(by, F.struct("average_latency", by)).alias("fastest"), F.min_by(by, F.struct("hallucination_rate", by)).alias("safest"), F.round(F.max("overall_score") - F.avg("overall_score"), 6).alias("lead"))


def tradeoff(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows (coverage, safe, density, forbidden, latency, tokens) with score: gains minus costs relative to the largest."""
    relative = ("density", "latency", "tokens")
    held = rows.join(F.broadcast(rows.agg(*[F.max(c).alias(f"__{c}") for c in relative])), how="cross")
    share = {c: F.col(c) / F.coalesce(F.nullif(F.col(f"__{c}"), F.lit(0.0)), F.lit(1.0)) for c in relative}
    gain = weights["coverage"] * F.col("coverage") + weights["safe"] * F.col("safe").cast("double") + weights["density"] * F.least(F.lit(1.0), share["density"])
    cost = weights["forbidden"] * F.least(F.lit(1.0), F.col("forbidden").cast("double")) + weights["latency"] * share["latency"] + weights["tokens"] * share["tokens"]
    return held.withColumn("score", F.round(gain - cost, 6)).drop(*[f"__{c}" for c in relative])


def answered(questions: DataFrame, answer: Callable[[dict], str | None], text: str = "answer") -> DataFrame:
    """questions with the answer of each and error: what one question raises is kept with it and stops no other."""
    schema = T.StructType([*questions.schema.fields, T.StructField(text, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    made.append(answer(row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{text: pd.Series(made, index=pdf.index, dtype=object), "error": pd.Series(errors, index=pdf.index, dtype=object)})

    return questions.mapInPandas(run, schema)


def sweep(grid: DataFrame, questions: DataFrame, factory: Callable[[dict], Callable[[DataFrame], DataFrame]], hooks: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """The rows of every experiment of a grid (see relations.grid), with its experiment_id and fingerprint.

    ``factory`` makes the pipeline of a setting, a function of the questions; settings are few and each is one branch of
    the plan. Every hook then adds its columns to all rows.
    """
    rows = None
    for setting in [r.asDict() for r in grid.collect()]:
        own = factory(dict(setting))(questions).withColumn("experiment_id", F.lit(setting["experiment_id"])).withColumn("fingerprint", F.lit(setting["fingerprint"]))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("the grid has no settings")
    for hook in hooks:
        rows = hook(rows)
    return rows


def tf_cosine(words: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, l, r, cosine of word counts for the pairs of a group that have a word in common. words: by, key, words."""
    counts = words.select(*by, key, F.explode("words").alias("w")).groupBy(*by, key, "w").agg(F.count("*").alias("n"))
    size = counts.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("m"))
    full = counts.join(size, [*by, key])
    a = full.select(*by, "w", F.col(key).alias("l"), F.col("n").alias("na"), F.col("m").alias("ma"))
    b = full.select(*by, "w", F.col(key).alias("r"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    pairs = a.join(b, [*by, "w"]).filter("l < r")
    return pairs.groupBy(*by, "l", "r").agg(F.round(F.sum(F.col("na") * F.col("nb")) / (F.first("ma") * F.first("mb")), 4).alias("cosine"))
