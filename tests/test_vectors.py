"""Vector search by blocks with bounds against all products."""

from __future__ import annotations

import numpy as np
import pytest

from harrier.operators import vector


def plain(points, queries, k):
    out = {}
    for q, v in queries:
        if v is None or not np.linalg.norm(v):
            continue
        scores = [(-round(float(np.dot(p, v) / (np.linalg.norm(p) * np.linalg.norm(v))), 9), i) for i, p in points if p is not None and len(p) == len(v) and np.linalg.norm(p) > 0]
        out[q] = [(i, pytest.approx(-s, abs=2e-9)) for s, i in sorted(scores)[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk, r.score))
    return out


def rows(n=1_500):
    """Points around some directions, one of them many times, and odd ones."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    points = [(i, (middle[i % 12] * 4 + rng.normal(size=16)).tolist()) for i in range(n)]
    points += [(n + i, points[5][1]) for i in range(300)]
    points += [(9_001, None), (9_002, [0.0] * 16), (9_003, [1.0, 2.0]), (9_004, [2.0, 1.0])]
    queries = [(f"q{i}", (middle[i % 12] * 4 + rng.normal(size=16)).tolist()) for i in range(25)] + [("short", [1.0, 1.0]), ("none", None), ("zero", [0.0] * 16)]
    return points, queries


@pytest.mark.parametrize("few_bytes", [False, True])
def test_blocks_that_cannot_matter_are_left_out(spark, monkeypatch, few_bytes):
    points, queries = rows()
    monkeypatch.setattr(vector, "BLOCK", 32)
    monkeypatch.setattr(vector, "WHOLE", 0)
    if few_bytes:  # queries in several parts
        monkeypatch.setattr(vector, "QUERY_BYTES", 1_500)
    frame = spark.createDataFrame(points, "vec_id int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, query_vector array<double>").repartition(2)
    blocks = vector.clustered(frame, block=32)
    assert found(vector.search_blocks(blocks, asked, 7)) == plain(points, queries, 7)
    assert found(vector.search(frame, asked, 7)) == plain(points, queries, 7)
    if not few_bytes:
        assert 0 < vector.share_compared(blocks, asked, 7) < 0.4
        assert blocks.count() > 50


def test_nothing_to_search(spark):
    schema = "vec_id int, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<double>")
    none = spark.createDataFrame([], schema)
    assert vector.search_blocks(vector.clustered(none), asked).collect() == [] == vector.search(none, asked).collect()
    some = vector.clustered(spark.createDataFrame([(1, [2.0])], schema))
    assert vector.search_blocks(some, asked.limit(0)).collect() == []
    assert [tuple(r) for r in vector.search_blocks(some, asked).collect()] == [(1, 1, 1.0, 1)]
