"""State machines on streams: jobs, quiet periods, and the record of finished queries."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harrier.streaming import machines


def stream(spark, tmp_path, batches, schema):
    """A stream of one file a micro-batch, in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    files = sorted((tmp_path / "in").glob("*/*.parquet"))
    (tmp_path / "flat").mkdir()
    import os
    import shutil

    for n, f in enumerate(sorted(files, key=lambda f: int(f.parent.name))):
        shutil.copy(f, tmp_path / "flat" / f"{n}.parquet")
        os.utime(tmp_path / "flat" / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")


JOBS = "job int, seq int, state string"


@pytest.mark.parametrize("enforce", [True, False])
def test_job_states(spark, tmp_path, enforce):
    batches = [[(1, 2, "extracting"), (1, 1, "claimed"), (2, 1, "claimed"), (3, 1, "claimed")], [(1, 3, "chunked"), (1, 4, "chunked"), (2, 2, "embedding"), (2, 3, "writing")], [(1, 5, "failed"), (1, 6, "claimed"), (3, 2, "completed")]]
    changes = machines.job_states(stream(spark, tmp_path, batches, JOBS), "job", "state", ["seq"], enforce=enforce)
    machines.split_jobs(changes, f"{tmp_path}/moved", f"{tmp_path}/rejected", f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda name: sorted(((r.job, r.previous, r.state, r.seq) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()), key=lambda r: (r[0], r[3]))
    assert read("rejected") == [(1, "failed", "claimed", 6), (2, "claimed", "embedding", 2)]
    moved = [(1, None, "claimed", 1), (1, "claimed", "extracting", 2), (1, "extracting", "chunked", 3), (1, "chunked", "failed", 5), (2, None, "claimed", 1), (3, None, "claimed", 1), (3, "claimed", "completed", 2)]
    moved.append((2, "claimed", "writing", 3) if enforce else (2, "embedding", "writing", 3))
    assert read("moved") == sorted(moved, key=lambda r: (r[0], r[3]))


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def test_paths_come_to_rest(spark, tmp_path):
    batches = [
        [("a", at(0), 1), ("a", at(5), 2), ("a", at(9), 2), ("b", at(0), 1), ("b", at(30), 1)],
        [("c", at(60), 1), ("a", at(52), 3)],  # the watermark is at 60 - 5 after this batch
        [("a", at(10), 9), ("c", at(69), 1)],  # the first is too late
        [("d", at(200), 1)],
        [("d", at(201), 1)],
    ]
    events = stream(spark, tmp_path, batches, "path string, ts timestamp, size int")
    machines.collected(machines.at_rest(events, "path", "ts", ["size"], "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted((r.path, r.first_event.isoformat(), r.at_rest.isoformat(), r.n, r.stable) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    time = lambda minute: at(minute).replace(tzinfo=None).isoformat()
    assert got == [("a", time(0), time(19), 3, True), ("a", time(52), time(62), 1, False), ("b", time(0), time(10), 1, False), ("b", time(30), time(40), 1, False), ("c", time(60), time(79), 2, True)]


def test_recorder_writes_ends_and_failures(spark, tmp_path):
    told = []

    def broken(row):
        raise RuntimeError("a handler")

    recorder = machines.Recorder(spark, f"{tmp_path}/ends", [broken, told.append])
    spark.streams.addListener(recorder)
    try:
        rows = stream(spark, tmp_path, [[(1,), (2,)], [(3,)]], "n int")
        fine = rows.writeStream.queryName("fine").format("noop").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
        fine.awaitTermination()
        assert recorder.wait(fine)
        bad = rows.select(F.raise_error(F.lit("no way")).alias("x")).writeStream.queryName("bad").format("noop").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no way"):
            bad.awaitTermination()
        assert recorder.wait(bad)
    finally:
        spark.streams.removeListener(recorder)
    got = {r.name: (r.batches > 0, r.rows, r.failed, r.error is None) for r in recorder.table().collect()}
    assert got["fine"] == (True, 3, False, True) and got["bad"][2:] == (True, False)
    assert [r[0] for r in told] == ["fine", "bad"] and len(recorder.broken) == 2
    assert {r.name: (r.queries, r.failures) for r in machines.recorded(recorder.table()).collect()} == {"fine": (1, 0), "bad": (1, 1)}
