"""Keyed state machines on streams: jobs with legal transitions, paths that come to rest, and a record of finished queries.

State is kept for each key by Spark's state store and moves with it when an executor is lost. A key's state is a few
values; what is no longer needed is cleared, by a terminal state or by an event-time timer.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from harrier.streaming.events import TERMINAL, TRANSITIONS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within this use the store that keyed state machines need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Jobs(StatefulProcessor):
    def __init__(self, allowed: Mapping[str, Sequence[str]], terminal: Sequence[str], enforce: bool, order: Sequence[str], columns: Sequence[str]):
        self.allowed, self.terminal, self.enforce, self.order, self.columns = dict(allowed), frozenset(terminal), enforce, list(order), list(columns)

    def init(self, handle) -> None:  # noqa: ANN001
        self.held = handle.getValueState("job", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = self.held.get()[0] if self.held.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.columns].itertuples(index=False):
            new = row[0]
            if new == now:
                continue
            fine = now is None or (now not in self.terminal and new in self.allowed.get(now, ()))
            out.append((key[0], now, *row, fine))
            now = new if fine or not self.enforce else now
        if now is not None:
            self.held.update((now,))
        yield pd.DataFrame(out, columns=["key", "previous", *self.columns, "legal"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str, state: str, order: Sequence[str], allowed: Mapping[str, Sequence[str]] = TRANSITIONS, terminal: Sequence[str] = TERMINAL, enforce: bool = True) -> DataFrame:
    """key, previous, state, the columns of ``order``, legal: each change of a job's state on a stream.

    The first state of a key is a change from null. Events of a micro-batch are taken in ``order``. A change that the
    table does not hold, or out of a terminal state, is not legal: with ``enforce`` the job stays where it is, else it is
    followed from where it went, as an audit does.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"key {kinds[key]}, previous string, `{state}` string, {', '.join(f'`{c}` {kinds[c]}' for c in order)}, legal boolean"
    made = events.select(key, state, *order).groupBy(key).transformWithStateInPandas(_Jobs(allowed, terminal, enforce, order, [state, *order]), schema, "Append", "None")
    return made.withColumnRenamed("key", key)


def split_jobs(changes: DataFrame, moved: str, rejected: str, checkpoint: str):  # noqa: ANN201
    """Legal changes go to one table and the others to another, in the same pass over each micro-batch.

    A batch that is run again after a loss overwrites its own rows.
    """

    def put(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        held.filter("legal").drop("legal").write.mode("overwrite").parquet(f"{moved}/batch={batch}")
        held.filter("not legal").drop("legal").write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
        held.unpersist()

    with keyed_state(changes.sparkSession):
        return changes.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Quiet(StatefulProcessor):
    """Holds the events of a path since it was last at rest: first and last time, how many, and the last two samples."""

    def __init__(self, ts: str, same: Sequence[str], quiet_ms: int):
        self.ts, self.same, self.quiet = ts, list(same), quiet_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.held = handle.getValueState("quiet", "first long, last long, n long, before string, now string")

    def row(self, key: tuple, held: tuple) -> tuple:
        first, last, n, before, now = held
        return key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last + self.quiet * 1000, unit="us"), n, before is not None and before == now

    def out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "first_event", "at_rest", "n", "stable"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, out = (self.held.get() if self.held.exists() else None), []
        if held is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        frame = pd.concat(list(rows)).sort_values([self.ts, *self.same], kind="stable")
        samples = frame[self.same].astype(str).agg("\x1f".join, axis=1)
        for at, sample in zip(frame[self.ts].astype("datetime64[us]").astype("int64"), samples, strict=True):
            if held is not None and at - held[1] >= self.quiet * 1000:
                out.append(self.row(key, held))
                held = None
            held = (at, at, 1, None, sample) if held is None else (min(held[0], at), max(held[1], at), held[2] + 1, held[4], sample)
        self.held.update(tuple(int(x) if isinstance(x, int) or hasattr(x, "item") else x for x in held))
        self.handle.registerTimer(-(-int(held[1]) // 1000) + self.quiet)
        yield self.out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.held.get() if self.held.exists() else None
        self.held.clear()
        yield self.out([self.row(key, held)] if held is not None else [])

    def close(self) -> None:
        pass


def at_rest(events: DataFrame, key: str, ts: str, same: Sequence[str], quiet: str, late: str) -> DataFrame:
    """key, first_event, at_rest, n, stable: a row for each run of events of a key, when it has been quiet so long.

    Every event starts the period anew. A timer on the watermark lets a key go and clears its state; events that are
    later than ``late`` are dropped. stable: the last two events agree on all columns of ``same``, as a file does whose
    size and time have come to rest.
    """
    kind = events.schema[key].dataType.simpleString()
    quiet_ms = int(pd.Timedelta(quiet) / pd.Timedelta(milliseconds=1))
    marked = events.select(key, ts, *same).withWatermark(ts, late)
    made = marked.groupBy(key).transformWithStateInPandas(_Quiet(ts, same, quiet_ms), f"key {kind}, first_event timestamp, at_rest timestamp, n long, stable boolean", "Append", "EventTime")
    return made.withColumnRenamed("key", key)


def collected(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Appends the rows of a state machine to a Parquet table, exactly once."""
    with keyed_state(stream.sparkSession):
        return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Recorder(StreamingQueryListener):
    """Writes a row to a table when a query ends: name, run, batches, rows read, failed, error.

    ``spark.streams.addListener`` starts it. Handlers are called with each row after it is written; one that fails is
    noted in ``broken`` and stops no other.
    """

    def __init__(self, spark: SparkSession, path: str, handlers: Sequence[Any] = ()):
        super().__init__()
        self.spark, self.path, self.handlers, self.broken = spark, path, list(handlers), []
        self._seen: dict[str, list] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _run(self, run: str) -> tuple[list, threading.Event]:
        with self._lock:
            return self._seen.setdefault(run, [None, 0, 0]), self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self._run(str(event.runId))[0][0] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        seen, _ = self._run(str(event.progress.runId))
        seen[1] += 1
        seen[2] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        run = str(event.runId)
        (name, batches, rows), ended = self._run(run)
        error = event.exception
        row = (name, run, batches, rows, error is not None, error.splitlines()[0] if error else None)
        try:
            self.spark.createDataFrame([row], "name string, run string, batches long, rows long, failed boolean, error string").coalesce(1).write.mode("append").parquet(self.path)
            for handler in self.handlers:
                try:
                    handler(row)
                except Exception as e:  # a handler is the caller's code
                    self.broken.append((handler, e))
        finally:
            ended.set()

    def wait(self, query, seconds: float = 60.0) -> bool:  # noqa: ANN001
        """Whether the row of a query has been written: the end of a query is told a little after it."""
        return self._run(str(query.runId))[1].wait(seconds)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def recorded(rows: DataFrame) -> DataFrame:
    """For each name: queries, rows, failures."""
    return rows.groupBy("name").agg(F.count("*").alias("queries"), F.sum("rows").alias("rows"), F.count_if("failed").alias("failures"))
