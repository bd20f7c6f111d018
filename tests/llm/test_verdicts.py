"""Verdicts that no contract fixes: what the forest rejects, and which secrets look live."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
from pyspark.sql import functions as F

from harrier.llm import quality, secrets

MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}")


def path(tree, x):
    feature, value, left, right, length = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if x[feature[at]] < value[at] else right[at]
    return length[at]


def test_scores_are_mean_path_lengths():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(quality.FEATURES)))
    forest = quality.grow(x, np.ptp(x, axis=0), trees=20, sample=64)
    far = np.full((1, x.shape[1]), 5.0)
    rows = np.concatenate([x[:40], far])
    want = [2.0 ** (-np.mean([path(t, r) for t in forest.trees]) / quality.usual_path(64)) for r in rows]
    assert np.allclose(forest.scores(rows), want) and forest.scores(far)[0] > forest.scores(x).max()


def test_forest_on_labelled_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, labels.filter("doc_id % 2 = 0")).filter("doc_id % 2 = 1 AND NOT base_failed")
    held = judged.join(labels.filter("quality is not null"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()
    share = {r.quality: r.gone / r.n for r in held}
    assert share[0] >= 0.95 and share[1] <= 0.01


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["tree", "House", "walks!", "blue", "of", "river"]) for _ in range(rng.randint(12, 20))) for _ in range(9000)]
    bad = [" ".join(rng.choice(["tree#", "House", "walks!!", "w$", "of"]) for _ in range(rng.randint(12, 20))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 9000)) for i in range(9300)], "doc_id long, quality int")
    known = quality.facts(docs, "doc_id", "text").orderBy("id").filter("not failed").collect()
    x, good = np.array([r.x for r in known]), np.array([r.id < 9000 for r in known])
    assert good.sum() > 8192
    forest, want = quality.fit(quality.facts(docs, "doc_id", "text"), labels), quality.grow(x[good], np.ptp(x, axis=0))
    assert forest.usual == quality.usual_path(int(good.sum()))
    assert all((a == b).all() for a, b in ((forest.feature, want.feature), (forest.value, want.value), (forest.length, want.length)))
    scores = want.scores(x)
    kinds = sorted(set(scores), reverse=True)
    gains = [(scores[~good] >= s).sum() / (~good).sum() - quality.CLEAN_PRICE * (scores[good] >= s).sum() / good.sum() for s in kinds]
    best = max(range(len(kinds)), key=lambda k: (gains[k], kinds[k]))
    assert gains[best] > 0 and forest.threshold == (kinds[best] + kinds[best + 1]) / 2
    kept = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert kept == {r.id for r, s in zip(known, scores, strict=True) if s <= forest.threshold}


def test_owned_spans_by_brute_force(spark):
    rng = random.Random(9)
    token = lambda: "".join(rng.choice("abcXYZ019_") for _ in range(rng.randint(24, 30))) + "a1"
    tokens = [token() for _ in range(40)] + [f"AKIA{'A1' * 10}", "deadbeef" * 4]
    rows = []
    for d in range(160):
        words = [rng.choice(["plain", "words", "of", "a", "text"]) for _ in range(rng.randint(2, 9))]
        for t in rng.sample(tokens, rng.randint(0, 2)):
            words.insert(rng.randrange(len(words)), rng.choice(["", "", "token=", "x:"]) + t)
        rows.append((d, " ".join(words), f"o{rng.randrange(6) if d % 2 else 0}"))
    rows += [(200 + i, "only Zq1" + "wE2r" * 6 + f" in copy {i % 4}", "o1") for i in range(12)]  # four texts of one owner
    rows += [(300 + i, "only Zq2" + "wE2r" * 6 + " in equal copies", "o1") for i in range(12)]  # one text of one owner
    owners, texts = {}, {}
    base = {d: [tuple(map(int, s.split(":")[1:])) for s in brute.op6_base(t)[4]] for d, t, _ in rows}
    for _, t, o in rows:
        for m in MIXED.finditer(t):
            owners.setdefault(m[0], set()).add(o)
            texts.setdefault(m[0], set()).add(t)
    want = {}
    for d, t, _ in rows:
        free = [m for m in MIXED.finditer(t) if not any(s < m.end() and e > m.start() for s, e in base[d])]
        want[d] = [(m.start(), m.end()) for m in free if len(owners[m[0]]) == 1 and len(texts[m[0]]) <= secrets.FEW]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    got = {r.doc_id: [(m.start, m.end) for m in r.findings if m.kind == 3] for r in found.collect()}
    assert got == want and not want[200] and want[300] and sum(map(len, want.values())) > 12
