"""Single operators on small hand-made rows; expected values are worked out by hand."""

from __future__ import annotations

import time
import uuid

import pytest
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import access, context, evaluation, evidence, filters, fusion, hierarchy, ingest, lexical, ranking, relations, retrieval, search, summaries, trace, vector
from harrier.plans.config import DEFAULTS
from harrier.sources import files


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_tokens_keep_joined_words_and_repeats(spark):
    assert one(spark, X.tokens(F.lit("Straße AGL-47 l'eau ÉTÉ été 日本"))) == ["straße", "agl-47", "l'eau", "été", "été", "日本"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_rewrite_keeps_a_very_long_question(spark):
    assert one(spark, F.length(X.rewrite(F.repeat(F.lit("runway "), 200_000)))) == 200_000 * 7 - 1


def test_query_transformations(spark):
    assert one(spark, X.rewrite(F.lit("  Could you please  tell me about runway rules ?! "))) == "Runway rules"
    assert one(spark, X.rewrite(F.lit("explain"))) == "Explain"
    assert one(spark, X.expand(F.lit("queue FOD runway"))) == "queue FOD runway | Related terms: airside, surface inspection, ATC clearance, passenger flow, terminal operations, holding area"
    q = spark.createDataFrame([(1, "Runway rules"), (2, "   ")], "i int, t string")
    got = rows(fusion.variants(q, "i", "t", "Library"), "variant_order", "technique")
    assert got == [(0, "original"), (1, "keyword_expansion"), (2, "domain_reformulation")]
    assert fusion.variants(q, "i", "t", "Library", rewriting=False, expansion=False, reformulation=False).count() == 1


def test_match_ladder(spark):
    cases = [("the plan", "", 100), ("the plan b", "", 94), ("see the plan", "", 90), ("plan of the day", "", 84), ("x", "about the plan", 74), ("x", "plan and the", 66), ("x", "y", 0)]
    df = spark.createDataFrame(cases, "t string, b string, want int")
    assert all(a == b for a, b in rows(df.select(X.match_score(F.col("t"), F.col("b"), F.lit("the plan")), "want")))
    assert one(spark, X.match_score(F.lit("Air Traffic Control"), F.lit(""), F.lit("atc"))) == 87
    assert one(spark, X.excerpt(F.lit("a" * 200 + "<b>hit</b>" + "z" * 400), F.lit("hit"))).startswith("…")


def test_join_overlapping(spark):
    assert one(spark, X.join_overlapping(F.lit("one two"), F.lit("two three"))) == "one two three"
    assert one(spark, X.join_overlapping(F.lit("one"), F.lit("two"))) == "one\ntwo"
    assert one(spark, X.join_overlapping(F.lit(""), F.lit("x"))) == "\nx"


def test_uuid5(spark):
    names = [f"src/{i}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows(df.select(X.uuid5(F.col("n"))))] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_bm25(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "zx-99 delta"), (4, "beta"), (5, "")], "id int, t string")
    index = lexical.build_index(chunks, "id", "t")
    q = spark.createDataFrame([(1, "ZX-99"), (2, "beta"), (3, ""), (4, "gamma gamma")], "query_id int, query string")
    got = {}
    for qid, chunk, score in rows(lexical.search(index, q), "query_id", "chunk", "score"):
        got.setdefault(qid, []).append((chunk, score))
    assert [c for c, _ in got[1]] == [3] and 3 not in got
    assert [c for c, _ in got[2]] == [1, 2, 4] and all(s == 1e-6 for _, s in got[2]) or got[2][0][1] > 0
    single = rows(lexical.search(index, spark.createDataFrame([(9, "gamma")], "query_id int, query string")), "score")[0][0]
    assert got[4][0][1] == pytest.approx(2 * single)
    none = spark.createDataFrame([], "chunk int")
    assert lexical.search(index, q, allowed=none).count() == 0
    scoped = rows(lexical.search(index, q, allowed=spark.createDataFrame([(3,)], "chunk int")), "query_id", "chunk", "score")
    assert scoped == [(1, 3, got[1][0][1])]
    with pytest.raises(ValueError):
        lexical.search(index, q, 0)


def test_half_of_all_chunks_scores_zero_and_is_dropped(spark):
    index = lexical.build_index(spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"), "id", "t")
    assert lexical.search(index, spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_vector_search(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, query_vector array<double>")
    assert rows(vector.search(points, q, 3), "chunk", "score") == [(1, 1.0), (3, round(2**-0.5, 9)), (2, 0.0)]
    assert rows(vector.search(points, q, 3, where=F.col("vec_id") > 1), "chunk") == [(3,), (2,)]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, "x", 9.0, 1), (1, "y", 8.0, 2), (1, "x", 1.0, 3)], "query_id int, chunk string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 0.9, 1), (1, "x", 0.8, 2)], "query_id int, chunk string, score double, rank int")
    got = fusion.fuse({"dense": a, "bm25": b}).collect()
    assert [(r.chunk, r.rank) for r in got] == [("x", 1), ("y", 2)] and got[0].rrf_score == round(1 / 61 + 1 / 62, 9) == got[1].rrf_score
    assert got[0].retrieval_ranks == {"dense": 1, "bm25": 2} and got[0].retrieval_scores == {"dense": 9.0, "bm25": 0.8}
    assert fusion.fuse({"dense": a, "bm25": b}, {"bm25": 2.0}).first().chunk == "y"


def test_dedup_keeps_best_and_first_place(spark):
    df = spark.createDataFrame([(1, "s", 1, "a", 0.5, ["o"]), (2, "s", 1, "b", 0.9, ["e"]), (3, "s", 1, "c", 0.9, ["o"]), (4, "s", None, "d", None, ["o"]), (5, "s", None, "e", 0.1, ["o"])], "pos int, src string, page int, t string, score double, matched_queries array<string>")
    got = sorted(rows(fusion.dedup_best(df, ["src", "page"], []), "pos", "t", "matched_queries"))
    assert got == [(1, "b", ["o", "e"]), (4, "d", ["o"]), (5, "e", ["o"])]


def test_neighbors(spark):
    corpus = spark.createDataFrame([("s", i) for i in range(5)], "src string, i int")
    seeds = spark.createDataFrame([(1, "s", 2, 0.5)], "q int, src string, i int, score double")
    assert sorted(rows(context.expand_neighbors(seeds, corpus, ["q"], "src", "i"), "i", "is_neighbor")) == [(1, True), (2, False), (3, True)]
    two = spark.createDataFrame([(1, "s", 2, 0.5), (1, "s", 3, 0.9)], "q int, src string, i int, score double")
    assert sorted(rows(context.expand_neighbors(two, corpus, ["q"], "src", "i"), "i", "score", "is_neighbor")) == [(1, 0.5, True), (2, 0.9, True), (3, 0.9, False), (4, 0.9, True)]


def test_merge_and_fit(spark):
    df = spark.createDataFrame([(1, 0, "one two", 0.1, 1), (1, 1, "two three", 0.7, 1), (1, 2, "other", 0.2, 2), (1, 4, "last", 0.3, 2)], "q int, i int, t string, score double, page int")
    got = sorted(rows(context.merge_overlapping(df, ["q"], "i", "t", "score", ["page"]), "label", "t", "score", "members"))
    assert got == [("0 .. 1", "one two three", 0.7, 2), ("2", "other", 0.2, 1), ("4", "last", 0.3, 1)]
    long = spark.createDataFrame([(1, 1, "s", "x" * 500), (1, 2, "s", "y")], "q int, n int, s string, t string")
    fitted = context.fit_chars(long, ["q"], ["n"], "t", "s", 180).collect()
    assert len(fitted) == 1 and fitted[0].truncated and len(fitted[0].t) == 180 - len("[1] s\n")
    assert sorted(rows(context.fit_tokens(spark.createDataFrame([("a", 1, "p q r"), ("a", 2, "s t"), ("a", 3, "u")], "g string, n int, t string"), "g", "n", "t", 4), "t", "tokens", "truncated")) == [("p q r", 3, False), ("s", 1, True)]


def test_packing_starts_afresh_after_a_break(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([4, 4, 4, 9, 1, 20, 1])], "g int, i int, s int")
    assert [r.bin for r in context.pack(df, ["g"], ["i"], "s", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3, 4]


def test_chunks(spark):
    text = "First part. " * 30 + "\n\n" + "Second " * 150 + "x" * 900
    parts = context.split_text(text, 700, 120)
    assert all(len(c) <= 700 for _, c in parts) and all(text[s : s + len(c)] == c for s, c in parts)
    assert context.split_text("short", 700, 120) == [(0, "short")] and context.split_text("", 700, 120) == []
    df = spark.createDataFrame([(1, text, "s"), (2, "short", "s"), (3, None, "s")], "id long, t string, src string")
    got = rows(context.chunk_documents(df, "id", "t", "src").orderBy("chunk_index"), "id", "chunk_index", "chunk_id")
    assert [g[1] for g in got] == list(range(len(parts) + 1)) and got[-1] == (2, len(parts), f"s:pna:c{len(parts)}")


def pool(spark, items):
    return spark.createDataFrame([(1, f"c{i}", t, s, x, i + 1) for i, (t, s, x) in enumerate(items)], "query_id int, chunk string, text string, source string, reranker_score double, rerank_rank int")


def decide(spark, items, **how):
    return {r.chunk: (r.selected, r.selection_reason or r.discard_reason) for r in evidence.select_evidence(pool(spark, items), evidence.Selection(**how)).collect()}


def test_evidence_selection_reasons(spark):
    words = lambda k, n: " ".join(f"w{k}{i}" for i in range(n))
    got = decide(spark, [(words(1, 30), "a", 0.95), (words(1, 30), "b", 0.9), (words(2, 30), "a", 0.85), (words(3, 30), "a", 0.8), ("", "d", 0.7), (words(4, 30), "e", 0.1)], threshold=0.5, min_selected=2, target_min=0, budget=500)
    assert got == {"c0": (True, "threshold_pass"), "c1": (False, "redundancy"), "c2": (True, "threshold_pass"), "c3": (False, "source_diversity_limit"), "c4": (False, "empty_text"), "c5": (False, "threshold_failed")}


def test_evidence_is_never_empty_while_candidates_are_usable(spark):
    got = decide(spark, [(f"weak {i} text", f"s{i}", -9.0 - i) for i in range(5)], target_min=0)
    assert [k for k, v in got.items() if v == (True, "adaptive_fallback")] == ["c0", "c1", "c2"]
    assert decide(spark, [(" ", "a", 1.0)]) == {"c0": (False, "empty_text")}


def test_evidence_budget(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(100))
    got = decide(spark, [(text(k), k, 0.9) for k in "abcde"], min_selected=1, target_min=0, target_max=250, budget=250)
    assert [v[0] for v in got.values()] == [True, True, False, False, False] and got["c3"][1] == "token_budget"


def test_rerank_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, None)], "query_id int, chunk string, rank int, s double")
    assert rows(evidence.rerank(df, F.col("s")).orderBy("rerank_rank"), "chunk", "rank_shift") == [("b", 1), ("a", -1), ("c", 0)]


def test_status_and_support(spark):
    assert one(spark, evidence.is_live(F.lit("What is the weather forecast?"))) and not one(spark, evidence.is_live(F.lit("What is knowledge?")))
    terms = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, evidence.supported(terms("what", "runway", "length"), terms("runway", "length", "x")))
    assert not one(spark, evidence.supported(terms("runway", "length"), terms("runway")))
    assert one(spark, evidence.final_status(F.lit(0), F.lit(False), F.lit(True), F.lit("none"), F.lit(False))) == "insufficient_evidence"


def test_access(spark):
    assert access.implied_by("edit") == ("edit", "manage") and access.implied_by("delete") == ("delete", "manage") and access.implied_by("?") == ("view",)
    docs = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, None, "p1")], "id int, owner string, path string")
    grants = spark.createDataFrame([(3,), (3,)], "g int")
    allowed = access.granted(docs, [(grants, "id", "g")], "id")
    look = lambda **k: sorted(r.id for r in access.visible(docs, "id", F.lit(True), [F.col("owner") == "a"], allowed, **k).collect())
    assert look() == [1, 3] and look(authenticated=False) == [] and look(paths=spark.createDataFrame([], "path string")) == []
    assert look(paths=spark.createDataFrame([("p1",)], "path string")) == [1, 3]


def test_hierarchy(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", None)], "id string, parent string")
    start = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in hierarchy.closure(start, edges).collect()} == {"b", "c", "d"}
    assert {r.id for r in hierarchy.closure(start, edges, down=False).collect()} == {"a", "b"}


def test_ingest(spark):
    now = spark.createDataFrame([("a", "1", 2), ("b", "2", 1), ("n", "9", 1)], "path string, h string, v int")
    before = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("x", "9", 1)], "path string, h string, v int")
    assert dict(rows(ingest.manifest_diff(now, before, "path", "h", "v"))) == {"a": "changed", "b": "unchanged", "n": "new", "x": "deleted"}
    assert rows(ingest.moves(now, before, "path", ["h"]), "old", "new") == [("x", "n")]
    assert len(ingest.FORMATS) == 21
    bad = spark.createDataFrame([("x",)], "chunk_id string")
    assert "document_id" in ingest.payload_contract(bad).first().missing


def test_evaluation(spark):
    made = [("Uses runway lights [1][2][1].", "answered", True, ["Runway", "lamp"], ["lie"], []), ("Insufficient evidence.", "", False, [], [], []), ("Sure!", "", False, [], [], ["a", ""]), ("", "", True, [], [], [])]
    df = spark.createDataFrame(made, "answer string, status string, should_answer boolean, expected array<string>, forbidden array<string>, citations array<string>")
    got = rows(evaluation.evaluate(df), "keyword_score", "passed", "hallucinated", "citation_count", "citation_quality")
    assert got == [(0.5, True, False, 2, 1.0), (1.0, True, False, 0, 0.0), (1.0, False, True, 2, 0.5), (0.0, False, False, 0, 0.0)]


def test_summaries_shrink(spark):
    df = spark.createDataFrame([("g", i, 100) for i in range(20)], "g string, i int, n int")
    out = rows(summaries.summarize(df, "g", "i", "n", 300).groupBy("level").count().orderBy("level"))
    assert [n for _, n in out][-1] == 1 and out[0] == (0, 7)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 7)] + [("b", 4.0), ("b", 4.0), ("b", None), ("c", None)], "g string, x double")
    got = {r.g: (r.p50, r.p95) for r in ranking.nearest_ranks(df, "g", "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (3.0, 6.0), "b": (4.0, 4.0)}  # index 2.5 rounds to 2


def test_search_page(spark):
    kinds = [spark.createDataFrame([("k", i, t, "", None) for i, t in enumerate(["plan", "plan b", "no"])], "kind string, id int, title string, body string, updated timestamp")]
    hits = search.ranked(kinds, "Plan")
    assert rows(search.page(hits, 1, 1), "id", "score", "band") == [(1, 94, "Highly relevant")] and rows(search.counts(hits)) == [("k", 2)]


def test_trace_and_stats(spark):
    stages = spark.createDataFrame([(1, "a", 1, "x", 0.5), (1, "b", 1, "x", 0.5)], "query_id int, stage string, rank int, chunk string, score double")
    assert set(trace.question_trace(stages).first().stages) == {"a", "b"}
    empty = spark.createDataFrame([], "n int, s string")
    assert tuple(trace.chunk_stats(empty, "n", "s").first()) == (0, 0, 0, 0.0, 0)


def test_whole_trace(spark):
    asked = spark.createDataFrame([(1, "first"), (2, "nothing")], "query_id int, query string")
    hit = "query_id int, source string, page string, chunk string, score double, rank int"
    dense = spark.createDataFrame([(1, "s", "1", "a", 0.9, 1), (1, "s", "2", "b", 0.8, 2)], hit)
    words = spark.createDataFrame([(1, "s", "2", "b", 5.0, 1), (1, "t", None, "c", 4.0, 2), (1, "t", None, "c", 3.0, 3)], hit)
    final = spark.createDataFrame([(1, "s", "2", "b", "x" * 40, ["bm25"], False), (1, "t", "", "c", "y" * 1200, ["dense", "bm25"], True)], "query_id int, source string, page string, chunk string, text string, retrieval_sources array<string>, truncated boolean")
    stages = {"retrieved": words, "deduplicated": words.limit(2), "expanded": words.withColumn("is_neighbor", F.col("rank") > 1), "compressed": final, "merged": words}
    lost = spark.createDataFrame([(1, "b", True, 1, "evidence", None), (1, "c", False, 2, None, "redundancy"), (1, "a", False, 3, None, "redundancy")], "query_id int, chunk string, selected boolean, rerank_rank int, selection_reason string, discard_reason string")
    times = spark.createDataFrame([(1, 0.5, 0.25, 3.0)], "query_id int, retrieval double, context double, generation double")
    got = trace.whole_trace(asked, {"dense": dense, "bm25": words}, stages, lost, times, budget=320)
    one, none = got.orderBy("query_id").collect()
    assert tuple(one.overlap) == (1, 1, 1, 3, 0.333333) and tuple(one.deduplication) == (3, 2, 1) and tuple(one.neighbor_expansion) == (2, 2, 3)
    assert one.funnel.counts["combined"] == 5 and one.funnel.counts["fused"] == 0 and one.funnel.tokens["compressed"] == 310
    assert tuple(one.token_usage) == (320, 310, 10, 2, 1, 96.88) and one.evidence.reasons == {"redundancy": 2} and tuple(one.latency) == (0.5, 0.25, 3.0, 3.75)
    assert (one.source_diversity.sources, one.source_diversity.pages) == (2, 1) and len(one.records["compressed"][1].preview) == 500
    assert {s.signal: s.state for s in one.signals} == {"token_budget": "tight", "bm25_value": "unique", "retriever_agreement": "fine", "latency": "generation", "source_diversity": "fine"}
    assert none.overlap.overlap_ratio is None and none.records["dense"] == [] and none.token_usage.used == 0 and none.evidence.reasons == {}
    back = trace.trace_json(got).select(F.from_json("trace", got.schema).alias("t")).select("t.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, got.collect()))
    bare = trace.whole_trace(asked, {"bm25": words}, {}).filter("query_id = 1").first()
    assert tuple(bare.overlap)[:4] == (0, 2, 0, 2) and bare.records["selected"] == []
    with pytest.raises(ValueError):
        trace.whole_trace(asked, {"other": words}, {})


def test_branches_that_pass_their_limits(spark):
    asked = spark.createDataFrame([(1, "x")], "query_id long, query string")
    fixed = lambda chunk: lambda q: q.select("query_id", F.lit(chunk).cast("long").alias("chunk"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    @F.udf("long")
    def slowly(x):
        time.sleep(20)
        return x

    def late(q):
        return fixed(2)(q).withColumn("chunk", slowly("chunk"))

    def told(q):
        raise TimeoutError

    def broken(q):
        raise KeyError("broken")

    def slow_fusion(found, weights, limit):
        return fusion.fuse(found, weights, limit=limit).withColumn("chunk", slowly("chunk"))

    get = lambda known, limits, **more: rows(retrieval.retrieve_surviving(asked, known, limits, **more).orderBy("rank"), "chunk", "degraded")
    begun = time.monotonic()
    assert get({"dense": fixed(1), "bm25": late}, {"bm25": 3.0}) == [(1, ["bm25"])]
    assert get({"dense": told, "bm25": fixed(2)}, {}) == [(2, ["dense"])]
    assert get({"dense": fixed(1), "bm25": fixed(2)}, {"fusion": 3.0}, fuse=slow_fusion) == [(1, ["fusion"])]
    assert get({"dense": fixed(1), "bm25": fixed(2)}, {"dense": 60.0}) == [(1, []), (2, [])]
    assert get({"dense": told}, {}) == []
    assert time.monotonic() - begun < 20
    with pytest.raises(KeyError):
        get({"dense": fixed(1), "bm25": broken}, {})


def test_defaults():
    assert (DEFAULTS.chunk_size, DEFAULTS.rrf_k, DEFAULTS.max_selected) == (700, 60, 8)


def test_places_and_sums_over_ranges(spark):
    df = spark.createDataFrame([(i, i % 3, i * 7 % 50) for i in range(200)], "i int, g int, v int").repartition(5)
    got = ranking.numbered(df, [F.desc("v"), "i"], "place").orderBy("place").collect()
    assert [r.place for r in got] == [*range(1, 201)] and [(-r.v, r.i) for r in got] == sorted((-r.v, r.i) for r in got)
    sums = {r.i: r.s for r in ranking.running(df, ["g"], ["i"], {"s": F.col("v")}).collect()}
    assert sums == {i: sum(j * 7 % 50 for j in range(i % 3, i + 1, 3)) for i in range(200)}
    turns = ranking.round_robin(df, "g", "i").orderBy("place").limit(4).collect()
    assert [r.i for r in turns] == [0, 1, 2, 3]
    scaled = {r.i: r.x for r in ranking.min_max(df, "v", "x").collect()}
    assert min(scaled.values()) == 0 and max(scaled.values()) == 1
    assert ranking.max_scaled(df.limit(0), "v", "x").count() == 0


def test_retrieval_modes(spark):
    asked = spark.createDataFrame([(1, "red fox"), (2, "none")], "query_id int, query string")
    docs = spark.createDataFrame([(10, "a red fox"), (11, "red red"), (12, "blue")], "chunk int, text string")
    points = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 0.0]), (13, None)], "vec_id int, embedding array<double>")
    vectors = spark.createDataFrame([(1, [0.0, 2.0])], "query_id int, query_vector array<double>")
    known = {"dense": retrieval.dense_retriever(points, vectors), "bm25": retrieval.lexical_retriever(lexical.build_index(docs, "chunk", "text")), "fixed": lambda q: q.select("query_id", F.lit(7).alias("chunk"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))}
    got = {mode: rows(retrieval.retrieve(asked, mode, known).orderBy("query_id", "rank"), "query_id", "chunk") for mode in ("dense", "bm25", "hybrid", "fixed")}
    assert got["dense"] == [(1, 11), (1, 10)] and got["fixed"] == [(1, 7), (2, 7)]
    assert {c for _, c in got["hybrid"]} == {10, 11} and {q for q, _ in got["bm25"]} == {1}
    assert retrieval.retrieve(asked, "hybrid", {"bm25": known["bm25"]}).count() == len(got["bm25"])
    with pytest.raises(ValueError):
        retrieval.retrieve(asked, "other", known)
    variants = fusion.variants(asked, "query_id", "query", "Library", rewriting=True)
    tagged = retrieval.retrieve_variants(variants, "bm25", known)
    best = fusion.dedup_best(tagged, ["chunk"], ["query_id"])
    assert {r.chunk for r in best.filter("query_id = 1").collect()} == {10, 11}


def test_published_index_is_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, None)], "id int, text string")
    store = files.Generations(spark, f"file://{tmp_path}/index")
    made = lexical.publish(store, docs, "id", "text")
    fresh = lexical.build_index(docs, "id", "text")
    assert sorted(rows(made.terms, "term", "df", "idf")) == sorted(rows(fresh.terms, "term", "df", "idf")) and rows(made.corpus, "n", "avgdl") == [(3, 4 / 3)]
    asked = spark.createDataFrame([(1, "two")], "query_id int, query string")
    assert rows(lexical.search(lexical.opened(store), asked), "chunk", "score") == rows(lexical.search(fresh, asked), "chunk", "score")
    with pytest.raises(ValueError):
        lexical.opened(files.Generations(spark, f"file://{tmp_path}/nothing"))


def test_context_pipeline_switches(spark):
    corpus = spark.createDataFrame([("s", i, f"word{i} word{i + 1}") for i in range(6)], "source string, chunk_index int, text string")
    hits = spark.createDataFrame([(1, "s", 2, 0.9), (1, "s", 2, 0.5), (1, "s", 5, 0.1)], "query_id int, source string, chunk_index int, score double")
    full = context.build_context(hits, corpus)
    assert full["deduplicated"].count() == 2 and full["expanded"].count() == 5
    assert [r.label for r in full["merged"].collect()] == ["1 .. 5"]
    plain = context.build_context(hits, corpus, context.ContextPlan(expand=False, merge=False, compress=False))
    assert rows(plain["compressed"].orderBy("reference_id"), "reference_id", "text", "truncated") == [(1, "word2 word3", False), (2, "word5 word6", False)]


def test_sweep_keeps_failures(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "q int, text string")

    def factory(setting):
        def answer(row):
            if row["q"] == 2 and setting["k"] == 1:
                raise KeyError("gone")
            return row["text"] * setting["k"]

        return lambda questions: evaluation.answered(questions, answer)

    got = evaluation.sweep(relations.grid(spark, {"k": [1, 3]}), asked, factory, [lambda r: r.withColumn("n", F.length("answer"))])
    assert sorted((r.experiment_id, r.q, r.answer, r.error, r.n) for r in got.collect()) == [("experiment_001", 1, "a", None, 1), ("experiment_001", 2, None, "KeyError: 'gone'", None), ("experiment_002", 1, "aaa", None, 3), ("experiment_002", 2, "bbb", None, 3)]


def test_filters_and_relations(spark):
    df = spark.createDataFrame([(1, "\\a\\b\\"), (2, "a/bc"), (3, "a/b/c")], "i int, p string")
    assert sorted(r.i for r in df.filter(filters.in_folders(F.col("p"), ["a/b/"])).collect()) == [1, 3]
    assert df.filter(filters.in_folders(F.col("p"), [])).count() == 0
    assert filters.scoped(df, None, "i").count() == 3 and filters.scoped(df, df.limit(0), "i").count() == 0
    page = filters.keyset_page(df.withColumn("u", F.lit(1)), "u", "i", 1, (1, 3))
    assert [r.i for r in page.collect()] == [2, 1]
    with pytest.raises(ValueError):
        relations.one_root_each([df, df], "i")
    assert relations.one_root_each([df], "i").count() == 3
    rows_ = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.5, 2.0), (4, 2.0, 5.0), (5, None, 0.0)], "i int, gain double, cost double").repartition(3)
    assert sorted(r.i for r in relations.pareto(rows_, ["gain"], ["cost"]).collect()) == [1, 2, 4]


def test_payload_and_anchor(spark):
    versions = spark.createDataFrame([("v1", None, "personal", "u", None, "o"), ("v2", "r", "enterprise", None, "d", "o"), ("v3", None, "enterprise", None, None, "o")], "document_version_id string, repository_id string, storage_scope string, owner_user_id string, department_id string, organization_id string")
    chunks = spark.createDataFrame([(v, i) for v in ("v1", "v2", "v3") for i in range(2)], "document_version_id string, chunk_index int")
    got = {(r.chunk_id, r.repository_id) for r in ingest.payload(chunks, versions).collect()}
    assert ("v1:0", "personal:u") in got and ("v2:1", "r") in got and ("v3:0", "organization:o") in got
    one = spark.createDataFrame([(None, 3, 4, "c"), (None, None, None, "c")], "s string, l int, p int, c string")
    assert [r.a for r in one.select(ingest.anchor(F.col("s"), F.col("l"), F.col("p"), F.col("c")).alias("a")).collect()] == ["slide:3", "chunk:c"]


def test_fusion_within_other_unions(spark):
    """Rankings that are cut by windows of their own, fused, and then met again with their fusion."""
    listed = lambda s: lexical.top_k(spark.range(4000).select((F.col("id") % 40).alias("query_id"), (F.col("id") * 7 + s * 100_000).alias("chunk"), (F.col("id") % 97).cast("double").alias("score")).repartition(5), ["query_id"], [F.desc("score"), F.col("chunk")], 10)
    found = {"dense": listed(0), "bm25": listed(1)}
    fused = fusion.fuse(found)
    every = relations.stacked([fused.select("query_id", "chunk", F.lit("fused").alias("part")), *[r.select("query_id", "chunk", F.lit(n).alias("part")) for n, r in found.items()]])
    assert {tuple(r) for r in every.groupBy("query_id").agg(F.count_if(F.col("part") == "fused").alias("f"), F.count("*").alias("n")).select("f", "n").collect()} == {(10, 30)}
