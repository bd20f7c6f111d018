"""Summaries of runs, queues, corpora and evidence. Each function groups once and returns one row for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.ranking import running

#: States of jobs that are not done yet.
ACTIVE = ("queued", "running", "retry_wait")


def share(test: Column) -> Column:
    """The share of rows that pass, null without rows."""
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def document_summary(rows: DataFrame, by: str, chars: str, source: str) -> DataFrame:
    """by, documents, chars, sources (sorted, distinct)."""
    return rows.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.coalesce(chars, F.lit(0))).alias("chars"), F.array_sort(F.collect_set(source)).alias("sources"))


def page_distribution(rows: DataFrame, document: str, page: str, n: int = 20, label: str = "No page") -> DataFrame:
    """document, page, chunks: the n pages with most chunks; a null page has a label."""
    named = rows.select(document, F.coalesce(F.col(page).cast("string"), F.lit(label)).alias(page))
    return named.groupBy(document, page).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), document, page).limit(n)


def top_sources(rows: DataFrame, source: str, page: str, score: str, n: int = 10) -> DataFrame:
    """source, chunks, pages, mean_score, max_score of the sources with most chunks."""
    found = rows.groupBy(source).agg(F.count("*").alias("chunks"), F.count_distinct(page).alias("pages"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.max(score), 6).alias("max_score"))
    return found.orderBy(F.desc("chunks"), F.desc("max_score"), source).limit(n)


def status_distribution(rows: DataFrame, status: Column, unknown: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(status, F.lit(unknown)).alias("status")).agg(F.count("*").alias("n"))


def run_summary(rows: DataFrame, by: str, status: str, statuses: Sequence[str], means: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """by, questions, a count for each status, mean_ of each duration (nulls left out), and the sums."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return rows.groupBy(by).agg(F.count("*").alias("questions"), *counts, *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def stage_totals(rows: DataFrame, stage: str, seconds: str, source: str) -> DataFrame:
    """stage, rows, seconds, sources."""
    return rows.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 4).alias("seconds"), F.count_distinct(source).alias("sources"))


def matrix(rows: DataFrame, by: Sequence[str], success: Column, means: Sequence[str], frontier: Column) -> DataFrame:
    """by, n, success_rate, mean_ over successes alone, and how many rows lie on the frontier."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(share(success), 6).alias("success_rate"), *[F.round(F.avg(F.when(success, F.col(c))), 4).alias(f"mean_{c}") for c in means], F.count_if(frontier).alias("frontier"))


def wide(rows: DataFrame, key: str, cell: Column, cells: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row for each key with a column ``cell__value`` for each cell and value, the largest if a cell repeats."""
    made = [F.max(F.when(cell == c, column)).alias(f"{c}__{name}") for c in cells for name, column in values.items()]
    return rows.groupBy(key).agg(*made)


def latency_stats(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    """stage, n, mean, median, lo, hi to six places. The median is exact: Spark keeps a count for each distinct value."""
    return rows.groupBy(stage).agg(F.count(seconds).alias("n"), *[F.round(f, 6).alias(a) for a, f in (("mean", F.avg(seconds)), ("median", F.median(seconds)), ("lo", F.min(seconds)), ("hi", F.max(seconds)))])


def progress(rows: DataFrame, done: Column, seconds: str, started: str, finished: str) -> DataFrame:
    """One row: total, completed, percent, mean seconds, eta (of what is left), elapsed and throughput an hour."""
    n, completed = F.count("*"), F.count_if(done)
    mean, elapsed = F.avg(F.when(done, F.col(seconds))), F.unix_timestamp(F.max(F.when(done, F.col(finished)))) - F.unix_timestamp(F.min(started))
    return rows.agg(n.alias("total"), completed.alias("completed"), F.round(100.0 * completed / F.nullif(n, F.lit(0)), 2).alias("percent"), F.round(mean, 6).alias("mean_seconds"), F.round(mean * (n - completed), 4).alias("eta"), elapsed.alias("elapsed"), F.round(3600.0 * completed / F.nullif(elapsed, F.lit(0)), 4).alias("per_hour"))


def queue_status(jobs: DataFrame, state: str = "state", operation: str = "operation", worker: str = "worker", finished: str = "finished_at") -> DataFrame:
    """operation, counts by state, active, workers on running jobs, and the last success."""
    active = F.col(state).isin(*ACTIVE)
    return jobs.groupBy(operation).agg(
        *[F.count_if(F.col(state) == s).alias(s) for s in (*ACTIVE, "succeeded", "failed")],
        F.count_if(active).alias("active"),
        F.count_distinct(F.when(F.col(state) == "running", F.col(worker))).alias("workers"),
        F.max(F.when(F.col(state) == "succeeded", F.col(finished))).alias("last_success"),
    )


def oldest_active(jobs: DataFrame, created: str, key: str, n: int = 25, state: str = "state") -> DataFrame:
    return jobs.filter(F.col(state).isin(*ACTIVE)).orderBy(created, key).limit(n)


def last_errors(jobs: DataFrame, finished: str, key: str, n: int = 10, state: str = "state") -> DataFrame:
    return jobs.filter(F.col(state) == "failed").orderBy(F.desc(finished), F.desc(key)).limit(n)


def storage_used(rows: DataFrame, by: str, size: str, live: Column, quota: int) -> DataFrame:
    """by, used (of live rows, 0 for none), over_quota."""
    used = F.coalesce(F.sum(F.when(live, F.col(size))), F.lit(0))
    return rows.groupBy(by).agg(used.alias("used"), (used > quota).alias("over_quota"))


def next_version(documents: DataFrame, versions: DataFrame, key: str, their_key: str, number: str) -> DataFrame:
    """key, next_version: one more than the largest, 1 for none."""
    most = versions.groupBy(F.col(their_key).alias("__key")).agg(F.max(number).alias("__n"))
    return documents.join(most, F.col(key) == F.col("__key"), "left").select(key, (F.coalesce("__n", F.lit(0)) + 1).alias("next_version"))


def repeats(rows: DataFrame, by: Sequence[str | Column], key: str) -> DataFrame:
    """by, n, first: the values that two rows or more have."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def repeat_counts(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """by, n, repeated: rows, and rows beyond the first of each value. Values are counted first, so none is a hot group."""
    each = rows.groupBy(by, F.sha2(F.coalesce(value, F.lit("")), 256).alias("__v")).agg(F.count("*").alias("__n"))
    return each.groupBy(by).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") - 1).alias("repeated"))


def gap_audit(chunks: DataFrame, by: str, index: str, empty: Column) -> DataFrame:
    """by, duplicates, missing (numbers between the least and the largest that no chunk has), empty_chunks."""
    held = chunks.groupBy(by).agg(F.min(index).alias("lo"), F.max(index).alias("hi"), (F.count(index) - F.count_distinct(index)).alias("duplicates"), F.collect_set(index).alias("nums"), F.count_if(empty).alias("empty_chunks"))
    return held.select(by, "duplicates", F.array_sort(F.array_except(F.sequence("lo", "hi"), "nums")).alias("missing"), "empty_chunks")


def ocr_summary(rows: DataFrame, by: str, tried: Column, succeeded: Column, seconds: str, chars: str) -> DataFrame:
    """by, files, tried, succeeded, success_rate of those tried, mean_seconds of those, and characters won."""
    n, good = F.count_if(tried), F.count_if(tried & succeeded)
    return rows.groupBy(by).agg(F.count("*").alias("files"), n.alias("tried"), good.alias("succeeded"), F.round(good / F.nullif(n, F.lit(0)), 6).alias("success_rate"), F.round(F.avg(F.when(tried, F.col(seconds))), 6).alias("mean_seconds"), F.coalesce(F.sum(F.when(tried & succeeded, F.col(chars))), F.lit(0)).alias("chars"))


def compression(rows: DataFrame, by: str, final: Column, whole: Column) -> DataFrame:
    """by, ratio of final to uncompressed characters; 0 where there are none."""
    return rows.groupBy(by).agg(F.round(F.coalesce(F.sum(final).cast("double") / F.nullif(F.sum(whole), F.lit(0)), F.lit(0.0)), 6).alias("ratio"))


def token_efficiency(rows: DataFrame, by: str, tokens: Column, selected: Column, final: Column) -> DataFrame:
    """by, candidate, selected, final tokens and reduction, in percent of the candidates, never below 0."""
    every, chosen, last = F.sum(tokens), F.coalesce(F.sum(F.when(selected, tokens)), F.lit(0)), F.coalesce(F.sum(F.when(final, tokens)), F.lit(0))
    return rows.groupBy(by).agg(every.alias("candidate"), chosen.alias("selected"), last.alias("final"), F.round(F.greatest(F.lit(0.0), 100.0 * (1.0 - last / F.nullif(every, F.lit(0)))), 2).alias("reduction"))


def citation_quality(citations: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """by, citations, a missing_ count for each field, complete and completeness: a field is missing if null or blank."""
    there = {f: F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False)) for f in fields}
    whole = F.lit(True)
    for test in there.values():
        whole = whole & test
    return citations.groupBy(by).agg(F.count("*").alias("citations"), *[F.count_if(~t).alias(f"missing_{f}") for f, t in there.items()], F.count_if(whole).alias("complete"), F.round(share(whole), 6).alias("completeness"))


def resume_state(asked: DataFrame, attempts: DataFrame, key: str, done: Column) -> DataFrame:
    """key, attempts, state of what is asked: completed, failed (attempts, none of them done) or pending."""
    tried = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_or(done).alias("done"))
    state = F.when(F.col("done"), "completed").when(F.col("attempts") > 0, "failed").otherwise("pending")
    return asked.select(key).join(tried, key, "left").select(key, F.coalesce("attempts", F.lit(0)).alias("attempts"), state.alias("state"))


def checklist(items: DataFrame, by: str, item: str, order: str, cited: Column, allowed: Column) -> DataFrame:
    """The items of a group, the first of those that differ in case alone, whose citations are all allowed."""
    fine = items.filter(F.size(F.array_except(cited, allowed)) == 0)
    return fine.groupBy(by, F.lower(F.trim(item)).alias("item")).agg(F.min(order).alias("first"))


def contribution(hits: DataFrame, technique: str, chunk: str, source: str, score: str) -> DataFrame:
    """technique, occurrences, chunks, sources, mean_score: what each variant of a question brought."""
    return hits.groupBy(technique).agg(F.count("*").alias("occurrences"), F.count_distinct(chunk).alias("chunks"), F.count_distinct(source).alias("sources"), F.round(F.avg(score), 6).alias("mean_score"))


def comparison(frames: dict[str, DataFrame], chunk: str, score: str) -> DataFrame:
    """mode, row_count, chunks, mean_score, max_score of several result sets."""
    made = [rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("row_count"), F.count_distinct(chunk).alias("chunks"), F.round(F.avg(score), 4).alias("mean_score"), F.round(F.max(score), 4).alias("max_score")) for mode, rows in frames.items()]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out


def repeated_chunks(hits: DataFrame, chunk: str, score: str, technique: str) -> DataFrame:
    """chunk, n, max_score, techniques (sorted) of the chunks found twice or more."""
    return hits.groupBy(chunk).agg(F.count("*").alias("n"), F.round(F.max(score), 6).alias("max_score"), F.array_sort(F.collect_set(technique)).alias("techniques")).filter("n > 1")


def funnel(rows: DataFrame, stages: dict[str, Column], tokens: Column) -> DataFrame:
    """stage, chunks, tokens: how many rows reach each stage, in their order."""
    reached = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in stages.items()]))
    return rows.select(F.explode(reached).alias("stage"), tokens.alias("tokens")).groupBy("stage").agg(F.count("*").alias("chunks"), F.sum("tokens").cast("long").alias("tokens"))


def summed_maps(rows: DataFrame, by: str, counters: Column) -> DataFrame:
    """by, key, total: maps of counters merged by sum."""
    return rows.select(by, F.explode(counters).alias("key", "v")).groupBy(by, "key").agg(F.sum("v").alias("total"))


def fingerprint(rows: DataFrame, by: str, key: str, digest: str, block: int = 10_000) -> DataFrame:
    """by, fingerprint: an order-sensitive hash of the rows of each group, by key.

    A group's rows are hashed in blocks of so many, and the hashes of the blocks, in their order, are hashed again: no
    row holds a group's rows. Two groups agree if they have the same rows in the same order.
    """
    placed = running(rows.select(by, key, digest), [by], [key], {"place": F.lit(1).cast("long")})
    line = F.concat_ws(":", F.col(key).cast("string"), F.col(digest))
    listed = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r["v"]), "|"), 256)
    blocks = placed.groupBy(by, F.floor((F.col("place") - 1) / block).alias("block")).agg(listed(F.col("place").alias("o"), line.alias("v")).alias("digest"))
    return blocks.groupBy(by).agg(listed(F.col("block").alias("o"), F.col("digest").alias("v")).alias("fingerprint"))


def run_metrics(rows: DataFrame, by: Sequence[str], means: Sequence[str], sums: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """by, rows, mean_ of each column (nulls left out), the sums, and how many rows each condition holds for."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])


def report_series(chunks: DataFrame, tokens: str = "tokens", source: str = "source", selected: str = "selected", final: str = "final", strength: str = "strength", reason: str = "discard_reason") -> DataFrame:
    """series, label, value: what a run's charts show, from a row for each candidate of each question.

    funnel (candidates, selected, final), tokens of the same, strengths and discard reasons, selection (selected and
    discarded), and the unique sources of candidates and of the selected. One pass over the rows, then one row of it.
    """
    chosen, kept = F.coalesce(F.col(selected), F.lit(False)), F.coalesce(F.col(final), F.lit(False))
    every = {
        ("funnel", "candidates"): F.count("*"),
        ("funnel", "selected"): F.count_if(chosen),
        ("funnel", "final"): F.count_if(kept),
        ("tokens", "candidates"): F.sum(tokens),
        ("tokens", "selected"): F.sum(F.when(chosen, F.col(tokens))),
        ("tokens", "final"): F.sum(F.when(kept, F.col(tokens))),
        ("selection", "selected"): F.count_if(chosen),
        ("selection", "discarded"): F.count_if(~chosen),
        ("diversity", "candidates"): F.count_distinct(source),
        ("diversity", "selected"): F.count_distinct(F.when(chosen, F.col(source))),
        **{("strengths", s): F.count_if(chosen & (F.col(strength) == s)) for s in ("strong", "medium", "weak")},
    }
    row = chunks.agg(*[F.coalesce(c.cast("long"), F.lit(0)).alias(f"v{i}") for i, c in enumerate(every.values())])
    cells = F.array(*[F.struct(F.lit(s).alias("series"), F.lit(label).alias("label"), F.col(f"v{i}").alias("value")) for i, (s, label) in enumerate(every)])
    reasons = chunks.filter(~chosen).groupBy(F.coalesce(F.col(reason), F.lit("unspecified")).alias("label")).agg(F.count("*").alias("value"))
    return row.select(F.inline(cells)).unionByName(reasons.select(F.lit("discard_reasons").alias("series"), "label", "value"))
