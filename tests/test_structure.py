"""Bins over blocks of a group, and closures by paths of doubled length."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from harrier.operators import context, hierarchy


def bins(rows, limit, count=None, wait=None):
    """rows (group, order, size, seconds): one pass in order."""
    out, held = {}, {}
    for g, o, n, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        used, k, first, b = held.get(g, (0, 0, t, -1))
        n = n or 0
        if b < 0 or (used > 0 and used + n > limit) or (count is not None and k == count) or (wait is not None and t - first > wait):
            used, k, first, b = 0, 0, t, b + 1
        held[g] = used + n, k + 1, first, b
        out[g, o] = b
    return out


@pytest.mark.parametrize("block", [65_536, 7, 1])
@pytest.mark.parametrize("count, wait", [(None, None), (3, None), (4, 25)])
def test_bins_by_pointers_equal_one_pass(spark, block, count, wait):
    if block == 1 and count == 3:
        pytest.skip("the other cases tell enough")
    rng = random.Random(block)
    rows, t = [], 0
    for i in range(150):
        t += rng.choice([0, 1, 5, 30])
        rows.append((rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 1, 5, 9, 10, 25, None]), t))
    frame = spark.createDataFrame(rows, "g string, o int, n int, t long").repartition(3)
    timed = frame.withColumn("at", F.timestamp_seconds("t"))
    got = context.pack(timed, ["g"], ["o"], "n", 10, count, "at" if wait else None, wait, block)
    assert {(r.g, r.o): r.bin for r in got.collect()} == bins(rows, 10, count, wait)
    assert got.columns == ["g", "o", "n", "bin"]


def test_bins_of_one_group_without_a_key(spark):
    rows = [(None, i, n, 0) for i, n in enumerate([4, 4, 4, 100, 0, 0, 3])]
    got = context.pack(spark.createDataFrame([(o, n) for _, o, n, _ in rows], "o int, n int"), [], ["o"], "n", 8, block=2)
    assert {(None, r.o): r.bin for r in got.collect()} == bins(rows, 8)
    assert context.pack(spark.createDataFrame([], "o int, n int"), [], ["o"], "n", 8).collect() == []


def ids(frame):
    return {r.id for r in frame.collect()}


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    edges = spark.range(1, n).select("id", (F.col("id") - 1).alias("parent"))
    rounds = []
    assert hierarchy.closure(spark.createDataFrame([(0,)], "id long"), edges, note=rounds.append).count() == n
    assert rounds[-1] <= 15


def test_closures_of_trees_and_other_graphs(spark):
    rng = random.Random(2)
    links = [(i, rng.randrange(max(0, i - 4), i)) for i in range(1, 120)] + [(50, 3), (200, 201), (201, 202), (202, 200), (203, 200), (202, 204), (7, None), (None, 3)]
    edges = spark.createDataFrame(links, "id int, parent int")
    for down in (True, False):
        for seeds in ([30], [5, 90], [200], [], [999]):
            want, todo = set(seeds), list(seeds)
            while todo:
                x = todo.pop()
                for low, high in links:
                    a, b = (high, low) if down else (low, high)
                    if a == x and b is not None and b not in want:
                        want.add(b)
                        todo.append(b)
            assert ids(hierarchy.closure(spark.createDataFrame([(s,) for s in seeds], "id int"), edges, down)) == want
    assert ids(hierarchy.cycles(edges)) == {200, 201, 202}
    assert ids(hierarchy.cycles(edges.filter("id < 200"))) == set()
