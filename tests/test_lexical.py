"""BM25 by blocks and segments against a plain scorer."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from harrier.operators import lexical
from harrier.sources import files
from harrier.sources.shared import shared_folder

TOKEN = re.compile(r"\w+(?:[-']\w+)*")


def plain(docs, queries, k, allowed=None):
    """query -> [(chunk, score)] by the formula, every chunk scored."""
    held = [(d, Counter(TOKEN.findall((t or "").lower()))) for d, t in docs]
    n, avg = len(held), sum(sum(c.values()) for _, c in held) / max(1, len(held))
    df = Counter(t for _, c in held for t in c)
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    out = {}
    for q, text in queries:
        asked = Counter(TOKEN.findall((text or "").lower()))
        rows = []
        for d, c in held:
            if allowed is not None and d not in allowed:
                continue
            s = round(sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t, m in asked.items() if c[t]), 9)
            if s:
                rows.append((-s if s > 0 else -sum(1 for t in asked if c[t]) / len(asked) * 1e-6, d))
        out[q] = [(d, pytest.approx(-s, abs=2e-9)) for s, d in sorted(rows)[:k]]
    return {q: r for q, r in out.items() if r}


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk, r.score))
    return out


def corpus(n, seed=1):
    """Words of very unequal frequency; one of them in half of all texts, and a rare word in some."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        t = rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randint(3, 40))
        t += ["everywhere"] * (i % 2) + ["rare-one"] * (3 if i in (17, 40) else 0) + ["rare-two"] * (i == 40)
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
    return [*rows, (n, ""), (n + 1, None)]


QUERIES = [(1, "rare-one everywhere w0 w1"), (2, "w5 w90 w200 w5"), (3, "unknown"), (4, ""), (5, "everywhere w0"), (6, "rare-two")]
ASKED = "query_id int, query string"


@pytest.mark.parametrize("size", [4, 64])
@pytest.mark.parametrize("small", [True, False])
def test_search_by_blocks_equals_scoring_everything(spark, monkeypatch, size, small):
    monkeypatch.setattr(lexical, "WHOLE", 0)
    if not small:  # terms dealt over groups, and no broadcast
        monkeypatch.setattr(lexical, "SMALL_ROWS", 0)
        monkeypatch.setattr(lexical, "DEAL", 3)
        monkeypatch.setattr(lexical, "BATCH", 2)
    docs = corpus(300)
    index = lexical.build_index(spark.createDataFrame(docs, "id int, t string").repartition(3), "id", "t", size=size)
    asked = spark.createDataFrame(QUERIES, ASKED)
    assert found(lexical.search(index, asked, 5)) == plain(docs, QUERIES, 5)
    assert found(lexical.search(index, asked, None)) == plain(docs, QUERIES, None)
    some = {i for i in range(300) if i % 7 == 0}
    assert found(lexical.search(index, asked, 3, allowed=spark.createDataFrame([(i,) for i in some], "chunk int"))) == plain(docs, QUERIES, 3, some)


def test_second_pass_leaves_postings_unread(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WHOLE", 0)
    docs = corpus(2_000)
    index = lexical.build_index(spark.createDataFrame(docs, "id int, t string"), "id", "t", size=16)
    asked = spark.createDataFrame(QUERIES, ASKED)
    read = {r.query_id: (r.read, r.postings) for r in lexical.postings_read(index, asked, 2).collect()}
    assert found(lexical.search(index, asked, 2)) == plain(docs, QUERIES, 2)
    assert read[1][1] > 1_500 and read[1][0] < 0.1 * read[1][1]  # common terms are read beside the rare one only
    assert read[2][0] < 0.5 * read[2][1] and all(a <= b for a, b in read.values())
    whole = {r.query_id: (r.read, r.postings) for r in lexical.postings_read(index, asked, None).collect()}
    assert all(a == b for a, b in whole.values())


def test_common_term_lies_in_many_blocks_and_files(spark, tmp_path):
    store = files.Generations(spark, f"file://{tmp_path}/index")
    index = lexical.publish(store, spark.createDataFrame(corpus(2_000), "id int, t string"), "id", "t", size=16)
    blocks = index.blocks.filter("term = 'everywhere'")
    assert blocks.count() > 100 and blocks.agg({"n": "max"}).first()[0] <= 40
    assert index.blocks.filter("term = 'rare-two'").count() == 1


def state(index, asked):
    return found(lexical.search(index, asked, 5)), sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()), index.corpus.select("n", "avgdl").first()


def test_updated_index_equals_one_built_afresh(spark, tmp_path):
    store = files.Generations(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "id int, t string")
    asked = spark.createDataFrame(QUERIES, ASKED)
    docs = dict(corpus(200))
    lexical.publish(store, frame([*docs.items()]), "id", "t", size=8)
    first = store.current()
    before = state(lexical.opened(store), asked)
    fresh = lambda: state(lexical.build_index(frame([*docs.items()]), "id", "t"), asked)
    assert before == fresh()

    new = {17: "rare-one replaced w5", 500: "rare-one rare-two w0", 501: None, 40: "everywhere"}
    docs |= new
    assert state(lexical.update(store, frame([*new.items()]), None, "id", "t", size=2), asked) == fresh()
    for gone in (500, 0, 3):
        del docs[gone]
    removed = spark.createDataFrame([(500,), (0,), (3,), (99_999,)], "id int")
    assert state(lexical.update(store, None, removed, "id", "t"), asked) == fresh()
    docs[500] = "back again w5 rare-two"  # an id that was gone, and one that was replaced before
    docs[17] = "w5 w5"
    assert state(lexical.update(store, frame([(500, docs[500]), (17, docs[17])]), spark.createDataFrame([(9,)], "id int"), "id", "t"), asked)[0] == state(lexical.build_index(frame([(i, t) for i, t in docs.items() if i != 9]), "id", "t"), asked)[0]
    del docs[9]
    assert state(lexical.opened(store), asked) == fresh()
    assert lexical.opened(store).gone.count() > 0
    compacted = lexical.compact(store)
    assert compacted.gone is None and state(compacted, asked) == fresh()
    assert state(lexical.opened(store, first), asked) == before  # readers of an older generation go on
    assert state(lexical.update(store, None, None, "id", "t"), asked) == fresh()
    with pytest.raises(ValueError):
        lexical.update(files.Generations(spark, f"file://{tmp_path}/nothing"), None, None, "id", "t")


@pytest.mark.parametrize("small", [True, False])
def test_scanned_texts_equal_scoring_everything(spark, tmp_path, monkeypatch, small):
    if not small:  # queries in parts, each of which reads the texts
        monkeypatch.setattr(lexical, "SMALL_ROWS", 4)
        monkeypatch.setattr(lexical, "SLICE", 7)
    docs, store = corpus(300), files.Generations(spark, f"file://{tmp_path}/counts")
    frame = spark.createDataFrame(docs, "id int, t string").repartition(3)
    asked = spark.createDataFrame(QUERIES, ASKED)
    index, fresh = lexical.scanned(store, frame, "id", "t"), lexical.build_index(frame, "id", "t")
    assert found(lexical.search(index, asked, 5)) == plain(docs, QUERIES, 5)
    assert found(lexical.search(index, asked, None)) == plain(docs, QUERIES, None)
    some = {i for i in range(300) if i % 7 == 0}
    assert found(lexical.search(index, asked, 3, allowed=spark.createDataFrame([(i,) for i in some], "chunk int"))) == plain(docs, QUERIES, 3, some)
    assert lexical.search(index, asked, 3, allowed=spark.createDataFrame([], "chunk int")).count() == 0
    assert lexical.search(index, spark.createDataFrame([(3, "unknown"), (4, "")], ASKED), 3).count() == 0
    told = lambda x: (sorted((r.term, r.df, round(r.idf, 9)) for r in x.terms.collect()), [(r.n, r.avgdl, pytest.approx(r.mean_raw)) for r in x.corpus.collect()])
    assert told(index) == told(fresh) == told(lexical.scanned(store, frame, "id", "t"))
    with pytest.raises(ValueError):
        lexical.search(index, asked, 0)


def test_scanned_texts_take_ids_of_any_kind_and_may_be_empty(spark, tmp_path):
    docs = [("b", "one two"), ("a", "two one"), ("c", "three"), ("d", None), ("e", "four"), ("f", "five")]
    index = lexical.scanned(files.Generations(spark, f"file://{tmp_path}/a"), spark.createDataFrame(docs, "id string, t string"), "id", "t")
    got = lexical.search(index, spark.createDataFrame([("q#1", "two two")], "query_id string, query string"), 1)
    assert [(r.query_id, r.chunk, r["rank"]) for r in got.collect()] == [("q#1", "a", 1)]
    none = lexical.scanned(files.Generations(spark, f"file://{tmp_path}/b"), spark.createDataFrame([], "id long, t string"), "id", "t")
    assert lexical.search(none, spark.createDataFrame(QUERIES, ASKED)).count() == 0 and none.corpus.first().n == 0


def test_rows_kept_of_slices_are_the_best_of_all(monkeypatch):
    """Scores in slices of a few chunks, and kept rows cut again and again, with ties of very many chunks."""
    rng = random.Random(3)
    wanted = lexical._Wanted.of(pa.table({"query_id": [1, 1, 2, 2, 3], "distinct_terms": [2, 2, 3, 3, 1], "term": ["a", "b", "b", "c", "d"], "weight": [1.5, 0.5, 2.0, -1.0, -0.5]}))
    texts = [rng.choices("abcdxyz", k=rng.randint(0, 4)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(texts[i : i + 50], pa.list_(pa.string()))], names=["chunk", "t"]) for i in range(0, 400, 50)]

    def best(k):
        told = [r for b in wanted.best((wanted.matched(x) for x in batches), k, 2.0, 1.5, 0.75) for r in b.to_pylist()]
        return sorted((r["query_id"], -r["score"], r["chunk"]) for r in told)

    every = best(None)
    monkeypatch.setattr(lexical, "PAIRS", 5)
    monkeypatch.setattr(lexical, "SCORES", 6)
    assert best(None) == every and len(every) > 300
    for k in (1, 4, 1_000):
        assert best(k) == [r for q in (1, 2, 3) for r in [x for x in every if x[0] == q][:k]]


def test_a_search_of_documents_writes_less_than_they_hold(spark):
    """The queries ask a set of questions once; an index of all postings took several times the documents' bytes."""
    folder, size = shared_folder(spark).removeprefix("file://"), lambda top: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))
    before = size(folder)
    assert entry.queries()["bm25_topk_batch"](spark, "/root/testdata/sf0.01").count() == 400
    assert size(folder) - before < 0.6 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")
