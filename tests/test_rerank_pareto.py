"""A loaded reranker, and frontiers against all pairs."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from harrier.operators import evidence, relations


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{random.random()}", "w").close()  # a file for each loading

        def model(queries, texts):
            assert len(queries) <= 5
            return [None if not t else len(set(q) & set(t)) / len(set(q) | set(t)) for q, t in zip(queries, texts, strict=True)]

        return model

    rows = [(q, i, "abc" if q == 1 else "xyz", t) for q in (1, 2) for i, t in enumerate(["abc", "ab", None, "xyz", "zz", "cab", ""])]
    frame = spark.createDataFrame(rows, "query_id int, rank int, query string, text string").repartition(12)
    got = {(r.query_id, r["rank"]): (r.reranker_score, r.rerank_rank, r.rank_shift) for r in evidence.rerank_by_model(frame, load, batch=5).collect()}
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) and 1 <= len(pids) <= 12  # no worker loaded it twice
    for q in (1, 2):
        scores = {i: None if not t else len(set(w) & set(t)) / len(set(w) | set(t)) for a, i, w, t in rows if a == q}
        order = sorted(scores, key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
        assert {i: got[q, i] for i in scores} == {i: (scores[i], k + 1, i - k - 1) for k, i in enumerate(order)}
    with pytest.raises(Exception, match="another number"):
        evidence.rerank_by_model(frame, lambda: lambda q, t: [1.0]).collect()


def frontier(rows, signs):
    good = [r for r in rows if None not in r[1:]]
    score = lambda r: [s * v for s, v in zip(signs, r[1:], strict=True)]
    beats = lambda a, b: all(x >= y for x, y in zip(score(a), score(b), strict=True)) and score(a) != score(b)
    return sorted(r[0] for r in good if not any(beats(o, r) for o in good))


@pytest.mark.parametrize("few", [50_000, 0])
def test_frontiers(spark, few):
    rng = random.Random(few)
    tables = {
        "values with ties": [(i, rng.randint(0, 12), rng.randint(0, 12), rng.choice([None, *range(12)])) for i in range(400)],
        "all on the frontier": [(i, i, 250 - i, (i * 7) % 251) for i in range(250)],
        "a plane": [(i, a, b, 24 - a - b) for i, (a, b) in enumerate((a, b) for a in range(12) for b in range(12))],
        "one value": [(i, 1, 2, 3) for i in range(60)],
        "none": [],
    }
    for name, rows in tables.items():
        frame = spark.createDataFrame(rows, "id int, a int, b int, c int").repartition(5)
        got = sorted(r.id for r in relations.pareto(frame, ["a", "b"], ["c"], few).collect())
        assert got == frontier(rows, (1, 1, -1)), name
    rows = tables["values with ties"]
    two = spark.createDataFrame([r[:3] for r in rows], "id int, a int, b int")
    assert sorted(r.id for r in relations.pareto(two, ["a"], ["b"], few).collect()) == frontier([r[:3] for r in rows], (1, -1))
    assert sorted(r.id for r in relations.pareto(two.withColumn("z", F.lit(-0.0)), [], ["b", "z"], few).collect()) == frontier([(r[0], r[2]) for r in rows], (-1,))
    with pytest.raises(ValueError):
        relations.pareto(two, [], [])
