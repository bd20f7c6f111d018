"""Event-time operators. Each works on batch and streaming DataFrames alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States of a job and what each may become.
TRANSITIONS = {
    "claimed": ("extracting", "writing", "completed", "retry_wait", "failed", "superseded", "cancelled"),
    "extracting": ("chunked", "retry_wait", "failed", "superseded", "cancelled"),
    "chunked": ("embedding", "retry_wait", "failed", "superseded", "cancelled"),
    "embedding": ("writing", "retry_wait", "failed", "superseded", "cancelled"),
    "writing": ("verifying", "retry_wait", "failed", "cancelled"),
    "verifying": ("completed", "retry_wait", "failed", "cancelled"),
}
TERMINAL = ("completed", "failed", "superseded", "cancelled")


def watermarked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late else events


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """by, window_start, n, total and average of value for each window; ``slide`` makes windows overlap."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = watermarked(events, ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("average"))
    return grouped.select(*by, F.col("w.start").alias("window_start"), "n", "total", "average")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """by, session_start, session_end, n: events no further apart than gap (a debounce)."""
    grouped = watermarked(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def state_changes(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before (batch)."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


def illegal(changes: DataFrame, state: str, allowed: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Changes (previous, state) that the table of transitions does not hold."""
    rows = changes.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], f"previous string, `{state}` string")
    return changes.join(F.broadcast(rows), ["previous", state], "left_anti")


def state_changes_stream(events: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """The same changes from a stream: key, previous, state and the time. Events of a batch are taken in time order."""
    kind = dict(events.dtypes)[key]

    def follow(k, batches, held):  # noqa: ANN001, ANN202
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for at, now in zip(rows[ts], rows[state], strict=True):
            if last is not None and now != last:
                out.append((k[0], last, now, at))
            last = now
        held.update((last,))
        yield pd.DataFrame(out, columns=[key, "previous", state, ts])

    return events.select(key, ts, state).groupBy(key).applyInPandasWithState(follow, f"`{key}` {kind}, previous string, `{state}` string, `{ts}` timestamp", "last string", "append", "NoTimeout")


def current_revisions(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The rows of the latest revision of each key; work for older ones is dropped."""
    return rows.withColumn("__top", F.max(revision).over(W.partitionBy(key))).filter(F.col("__top") == F.col(revision)).drop("__top")


def stable(samples: DataFrame, key: str, ts: str, same: list[str]) -> DataFrame:
    """Keys whose last two samples agree on all of ``same``."""
    w = W.partitionBy(key).orderBy(F.desc(ts))
    top = samples.withColumn("__n", F.row_number().over(w)).filter("__n <= 2")
    agg = top.groupBy(key).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"__{c}") for c in same])
    test = F.col("n") == 2
    for c in same:
        test = test & (F.col(f"__{c}") == 1)
    return agg.filter(test).select(key)


def publish(stream: DataFrame, generations, checkpoint: str):  # noqa: ANN001, ANN201
    """Each micro-batch becomes a generation: written first, then pointed to."""
    return stream.writeStream.foreachBatch(lambda rows, _: generations.publish(rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(events: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, total, largest of what an event bus has seen so far; on a stream, in update or complete mode."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("largest"))


def trace_lines(events: DataFrame) -> DataFrame:
    """Each event as one line of JSON, without null fields."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def named(writer, name: str | None):  # noqa: ANN001, ANN201
    return writer if name is None else writer.queryName(name)


def write_trace(stream: DataFrame, path: str, checkpoint: str, name: str | None = None):  # noqa: ANN201
    """Appends every event of a stream to a folder of JSON lines, exactly once."""
    return named(trace_lines(stream).writeStream, name).format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_progress(stream: DataFrame, generations, checkpoint: str, name: str | None = None):  # noqa: ANN001, ANN201
    """Keeps the last complete state of a stream's groups as a generation: readers see one state or the next."""
    return named(stream.writeStream, name).outputMode("complete").foreachBatch(lambda rows, _: generations.publish(rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
