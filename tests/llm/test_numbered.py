"""The numbered operators against plain Python, on real rows and on hard cases."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import harrier.llm.substrings as substrings
from harrier.llm import chunks, cuckoo, decontaminate, lines, mixing, quality, secrets, simhash, similar, suffix_arrays, tokens, warc, word_windows
from harrier.llm import textops as T
from harrier.llm.components import components
from harrier.llm.queries import ORACLES, QUERIES

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"


def corpus():
    """doc_id, text: nulls, blanks, copies, near copies, shared passages and lines, repeats, odd characters."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "ré", "ño", "ß", "x1", "Qu", "日本"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(0, None), (1, ""), (2, " \t\n\x0b "), (3, LONG), (4, LONG), (5, LONG.upper()), (6, "short"), (7, "short")]
    shared = [text(40) for _ in range(4)]
    base = [text(rng.randint(5, 120)) for _ in range(12)]
    for i in range(60):
        parts = [rng.choice(base), text(rng.randint(0, 30))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 2), rng.choice(shared))
        if i % 7 == 0:
            words = parts[0].split()
            words[rng.randrange(len(words))] = "changed"
            parts[0] = " ".join(words)
        rows.append((10 + i, rng.choice(["\n", " ", "\n\n", "\t"]).join(parts)))
    rows += [(200, "ab " * 400), (201, "ab " * 390 + "c"), (202, "\x00\x01" * 60), (203, "\x00\x01" * 70), (204, "zz\n" + "same line here ok\n" * 5), (205, "Same LINE here ok \nother")]
    return rows


def frame(spark, rows, parts=3, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({"bucket": F.lit("clash"), "id": F.lit(1), "kind": F.lit(2), "score": F.lit(0)}) if extra else df


def result(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def test_line_dedup(spark):
    docs = frame(spark, corpus())
    got = lines.dedup(docs, lines.build(docs)).withColumn("sha", F.sha2("kept_text", 256))
    assert result(got, "n_lines", "n_dropped", "sha") == brute.op1(corpus())
    assert set(docs.columns) <= set(got.columns)


def test_line_index_is_reversible(spark):
    rows = corpus()
    first, later = frame(spark, rows[:40]), frame(spark, rows[40:])
    every = frame(spark, rows)
    grown = lines.insert(lines.build(first, shards=3), later)
    sha = F.sha2("kept_text", 256)
    assert result(lines.dedup(every, grown).withColumn("sha", sha), "n_lines", "n_dropped", "sha") == brute.op1(rows)
    gone = every.filter("doc_id in (3, 10, 11, 12, 204)").select("doc_id")
    rest = [r for r in rows if r[0] not in (3, 10, 11, 12, 204)]
    shrunk = lines.delete(grown, gone)
    assert result(lines.dedup(frame(spark, rest), shrunk).withColumn("sha", sha), "n_lines", "n_dropped", "sha") == brute.op1(rest)
    again = lines.insert(shrunk, every)
    assert result(lines.dedup(every, again).withColumn("sha", sha), "n_lines", "n_dropped", "sha") == brute.op1(rows)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64)
    table = cuckoo.build(keys)
    assert cuckoo.contains(table, keys).all()
    assert cuckoo.contains(table, keys + np.uint64(1)).mean() < 0.01
    fewer = cuckoo.delete(table, keys[:2000])
    assert cuckoo.contains(fewer, keys[2000:]).all() and cuckoo.contains(fewer, keys[:2000]).mean() < 0.01
    assert cuckoo.contains(cuckoo.insert(fewer, keys[:2000]), keys).all()
    with pytest.raises(cuckoo.Full):
        cuckoo.insert(cuckoo.empty(4), keys[:500])
    with pytest.raises(KeyError):
        cuckoo.delete(cuckoo.empty(4), keys[:1])
    assert (cuckoo.build(np.zeros(0, np.uint64)) == 0).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_word_windows(spark, parts):
    got = word_windows.remove_repeated(frame(spark, corpus(), parts), with_text=True)
    assert result(got, "n_words", "n_removed", "kept_sha256") == brute.op2(corpus())
    one = got.filter("doc_id = 4").first()
    assert one.kept_text == "" and one.spans == [0, 18]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_array_dedup(spark, hot):
    got = substrings.remove_repeated(frame(spark, corpus(), 4), hot=hot, with_text=True)
    assert result(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op7(corpus())
    assert got.filter("doc_id = 4").first().spans == [0, len(LONG)]


def test_suffix_array_dedup_merges_shards():
    """Four excerpts, two of one anchor, in shards that hold one excerpt each."""
    bodies = [LONG.encode()[k : k + 80] for k in (0, 5, 9, 20)]
    for keys, limit in (([1, 1, 1, 1], 100), ([1, 1, 1, 2], 100), ([1, 1, 1, 1], 10_000)):
        row = {"bucket": 3, "part": 0, "chunk": 7, "ids": np.array([5, 2, 9, 1]).tobytes(), "counts": np.ones(4, np.uint32).tobytes(), "lens": np.array([80] * 4, np.uint8).tobytes(), "keys": np.array(keys, np.uint32).tobytes(), "at": None, "body": chunks.zipped(b"".join(bodies))}
        (got,) = substrings.merge_shards(pa.Table.from_pylist([row], substrings.SENT), 50, limit).to_pylist()
        bits = np.unpackbits(np.frombuffer(chunks.unzipped(got["bits"], 16), np.uint8), count=got["n"]).astype(bool)
        held = [(k, i, b[i : i + 50]) for k, i, b in ((k, i, b) for k, b in enumerate(bodies) for i in range(31))]
        ids = [5, 2, 9, 1]
        want = [any(ids[m] < ids[k] and keys[m] == keys[k] and s == t for m, _, t in held) for k, _, s in held]
        assert bits.tolist() == want


def test_binary_search_in_suffix_order():
    rng = np.random.default_rng(3)
    for length in (3, 8, 13, 50):
        raw = rng.integers(97, 99, 400).astype(np.uint8)
        valid = np.arange(400) + length <= 400
        starts, group, heads = suffix_arrays.repeated(raw, valid, length)
        words = [raw[s : s + length].tobytes() for s in starts.tolist()]
        assert words == sorted(words) and all((a == b) == (x == y) for a, b, x, y in zip(words, words[1:], group, group[1:], strict=False))
        head = np.unique(group, return_index=True)[1]
        rows = suffix_arrays.spelled(heads, starts[head], length)
        half = rows[::2]
        at, there = suffix_arrays.find(half, rows)
        assert there.tolist() == [k % 2 == 0 for k in range(len(rows))] and (at[::2] == np.arange(len(half))).all()
        both, ids = suffix_arrays.merged((half, np.full(len(half), 5)), (rows[1::2], np.full(len(rows[1::2]), 4)))
        assert (both == rows).all() and ids.tolist() == [5 - k % 2 for k in range(len(rows))]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_array_dedup_of_a_passage_that_stands_twice(spark, hot):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(12):
        passage, left, right = noise(rng.randint(50, 120)), noise(70), noise(70)
        rows += [(10 * k, noise(90) + passage + noise(90)), (10 * k + 1, (left + passage + right) * 2), (10 * k + 2, noise(80) + (left[-9:] + passage + right[:9] + noise(60)) * 3), (10 * k + 3, passage * 3)]
    got = result(substrings.remove_repeated(frame(spark, rows), hot=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op7(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, low = int(rng.integers(0, 120)), 0 if trial % 5 == 0 else 97
        data = rng.integers(low, low + int(rng.integers(1, 4)), n).astype(np.uint8)
        order, heads = suffix_arrays.suffix_order(data)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        want = [0]
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            k = 0
            while max(a, b) + k < n and raw[a + k] == raw[b + k]:
                k += 1
            want.append(k)
        assert suffix_arrays.common_prefixes(data, order, heads).tolist() == want[:n]


def test_equal_and_null_ids(spark):
    rows = [(1, LONG), (1, LONG), (None, LONG), (None, LONG)]
    for op in (word_windows.remove_repeated, substrings.remove_repeated):
        got = sorted((r.doc_id or 99, r.n_removed > 0) for r in op(frame(spark, rows)).collect())
        assert got == [(1, False), (1, False), (99, True), (99, True)]
    docs = frame(spark, rows)
    got = sorted((r.doc_id or 99, r.n_dropped) for r in lines.dedup(docs, lines.build(docs)).collect())
    assert got == [(1, 0), (1, 0), (99, 1), (99, 1)]


@pytest.mark.parametrize("size", [40, 700])
def test_repeats_across_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    monkeypatch.setattr(chunks, "CHUNK_DOCS", 3)
    docs = chunks.chunked(frame(spark, corpus(), 3), "doc_id", "text")
    assert sum(len(chunks.opened(r.asDict()).ids) for r in docs.collect()) == len(corpus())
    assert result(word_windows.remove_repeated(frame(spark, corpus(), 3)), "n_words", "n_removed", "kept_sha256") == brute.op2(corpus())
    assert result(substrings.remove_repeated(frame(spark, corpus(), 3)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op7(corpus())


def test_levels_double():
    assert word_windows.lengths(13) == [4, 8, 13] and word_windows.lengths(3) == [3] and word_windows.lengths(50) == [4, 8, 16, 32, 50]


def test_quality_base_and_verdict(spark):
    rng = random.Random(2)
    good = [(500 + i, " ".join(rng.choice(["tree", "house", "walks", "blue", "of", "and", "river", "stone", "talks"]) + str(rng.randrange(300)) for _ in range(60)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(999)}{rng.choice('#$%&')}{rng.choice('#$%&')}" for _ in range(60))) for i in range(40)]
    docs = frame(spark, good + bad + corpus()[:3])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:20]] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = result(quality.judge(docs, labels), *quality.BASE, "base_failed", "kept")
    for d, t in good + bad + corpus()[:3]:
        assert got[d][:5] == brute.op3_base(t)
    assert all(got[i][6] for i, _ in good) and not any(got[i][6] for i, _ in bad)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {d for d, v in got.items() if v[6]}
    alone = quality.judge(docs, labels.limit(0))
    assert alone.filter("kept = base_failed").count() == 0


def test_quality_counts_on_hard_texts(spark):
    got = result(quality.judge(frame(spark, corpus()), spark.createDataFrame([], "doc_id long, quality int")), *quality.BASE)
    assert got == {d: brute.op3_base(t) for d, t in corpus()}


def test_token_counts(spark):
    library, path = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [*corpus(), (300, "a<|endoftext|>b  <|endoftext|>"), (301, "aaaaaaaaaaaaa hahahahahaha  \x1c\x85　 x'll don't 's ½⁷ ٣٤"), (302, "🎉" * 50)]
    want = library.Tokenizer.from_file(path)
    got = result(tokens.count_tokens(frame(spark, rows), path, limit=20), "n_bytes", "n_tokens", "over_limit")
    for d, t in rows:
        n = len(want.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 20)


def test_token_memory_is_bounded(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rules = tokens.load_merges(path)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    texts = [t or "" for _, t in corpus()]
    want = tokens.text_counts(texts, rules)
    assert [tokens.text_counts([t], rules)[0] for t in texts] == want


def pages():
    rng = random.Random(1)
    html = lambda n: "<p>" + "".join(rng.choice("abcdé ") for _ in range(n)) + "</p>"
    big, small = html(2000), html(100)
    noise = "".join(chr(rng.randrange(1, 0x2FF)) for _ in range(5000))
    return [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (7, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (8, "u", noise), (9, "u", html(998)), (10, "u", "x" * 1000), (11, "u", "x" * 1000)]


def test_warc_round_trip(spark):
    import hashlib

    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc.round_trip(spark, df, with_payload=True).collect()}
    assert len(got) == len(pages())
    for i, _, h in pages():
        raw = (h or "").encode()
        same = [j for j, _, x in pages() if (x or "").encode() == raw and len(raw) >= 1000]
        revisit = bool(same) and i != max(same)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", max(same)) if revisit else ("response", None))
        assert bytes(got[i].payload) == (b"" if revisit else raw)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once():
    import io

    members = [warc.record_bytes(i, "u", bytes(random.Random(i).randbytes(i * 40)) + b"\x1f\x8b\x08" * 20, "", None) for i in range(1, 30)]
    data = b"".join(members)
    for split in (17, 100, 1000, len(data)):
        found = [r for s in range(0, len(data), split) for r in warc.members(warc.Bytes(io.BytesIO(data), len(data)), s, min(len(data), s + split))]
        assert found == [zlib.decompress(m, 31) for m in members]
    with pytest.raises(ValueError):
        list(warc.members(warc.Bytes(io.BytesIO(data[:-4]), len(data) - 4), 0, len(data)))


def secret_rows():
    key = "AKIA" + "ABCDEFGH12345678"
    return [(1, f'é password = "hunter2secret" and token=secret:abcdefghij {key}'), (2, "api_key: 12345678 APIKEY='abc' passwd=" + "0123456789abcdef" * 3), (3, f"{key} AKIASHORT x{'ab12' * 10}"), (4, None), (5, "Secret=aaaaaaaa,token:bbbbbbbb"), (6, "say Zx9" + "kLmN0pQr" * 3 + " here"), (7, "copy Ab1" + "cDeF2gHi" * 3), (8, "copy Ab1" + "cDeF2gHi" * 3)]


def test_secret_scan(spark):
    rows = secret_rows()
    docs = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))
    found = secrets.scan(docs)
    got = {r.doc_id: (r.base, r.every) for r in found.select("doc_id", secrets.spans(F.filter("findings", lambda m: m["kind"] < 3)).alias("base"), secrets.spans(F.col("findings")).alias("every")).collect()}
    for d, t in rows:
        assert got[d][0] == ",".join(brute.op6_base(t)[4])
    assert got[6][1] == "owned:4:31" and got[7][1] == got[8][1] == ""
    live = {r.doc_id: [m.live for m in r.findings] for r in found.collect()}
    assert live[1][-1] is False and live[5] == [True, True]


@pytest.mark.parametrize("n", [5, 20])
def test_mixing(spark, n):
    rng = random.Random(n)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), None if i % n == 0 else f"s{i % n}") for i in range(400)] + [(1000 + i, "x " * 30, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) or {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if weight[s] * level >= 2 * sizes[s]}
        if more == capped:
            break
        capped = more
    taken = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert abs(r.target - min(weight[r.source] * level, 2 * sizes[r.source])) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - min(weight[s] * level, 2 * sizes[s])) <= 80 for s in sizes) and sum(taken.values()) <= budget + 0.5


def test_mixing_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect())
    assert [g[:2] for g in got] == [(1, 2), (1, 2), (2, 0), (3, 0)] and all(g[2] in (2, 4) for g in got[:2])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rows, items = corpus(), [(1, LONG), (2, "Short"), (3, None), (4, "!!"), (5, "tempor, INCIDIDUNT ut"), (10, LONG), (11, corpus()[20][1])]
    docs, tests = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MAX_WINDOWS, 3):
        got = decontaminate.find_hits(docs, tests, max_windows=most).withColumn("n", F.size("item_ids")).withColumn("sha", F.sha2(F.array_join("item_ids", ","), 256)).withColumn("bad", F.col("n_hit") > 0)
        assert result(got, "n_words", "n_hit", "n", "sha", "bad") == brute.op9(rows, items)
    want = brute.op9(rows, items)
    assert {r.doc_id for r in decontaminate.clean_documents(docs, tests).collect()} == {d for d, v in want.items() if not v[4]}
    spans = {r.doc_id: r.text for r in decontaminate.clean_documents(docs, tests, remove="spans").collect()}
    assert spans[0] is None and spans[3].strip() == "" and all(spans[d] == t for d, t in rows if not want[d][4])
    assert decontaminate.find_hits(docs, tests.limit(0)).filter("n_hit > 0").count() == 0


def test_simhash(spark):
    got = simhash.near_duplicates(frame(spark, corpus()), shingle=4).withColumn("hex", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert result(got, "hex", "component_id") == brute.op10(corpus())


@pytest.mark.parametrize("pairwise", [simhash.PAIRWISE, 3])
def test_simhash_links_of_a_dense_group(spark, pairwise):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    points = {center} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.u: r.v for r in components(simhash.near_links(nodes, pairwise)).collect()}
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {p: find(p) for p in signed if find(p) != p}


@pytest.mark.parametrize("part", [similar.PART, 4])
def test_near_duplicates_of_stated_similarity(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, group = [(0, None), (1, " "), (2, "one"), (3, "one")], {0: 0, 1: 0, 2: 2, 3: 2}
    for g in range(8):
        base = fresh(300)
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(300), 1 if k else 0):
                words[at] = "changed"
            d = 100 + 20 * g + k
            rows.append((d, " ".join(words)))
            group[d] = 100 + 20 * g
    for k in range(60):
        rows.append((1000 + k, " ".join(fresh(rng.randrange(5, 300)))))
        group[1000 + k] = 1000 + k
    got = result(similar.near_duplicates(frame(spark, rows)), "component_id", "component_size")
    assert {d: v[0] for d, v in got.items()} == group and got[100][1] == 12
    kept = similar.one_of_each(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {*group.values()} and "bucket" in kept.columns
    assert similar.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_in_a_large_bucket(spark, monkeypatch):
    for name, value in (("PART", 4), ("BANDS", 1), ("ROWS", 1)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, rows, want = fresh(240), [], {}
    for k in range(30):
        own = fresh(140)
        one, two = (" ".join(template + own + fresh(20)) for _ in range(2))
        rows += [(2 * k, one), (2 * k + 1, two)]
        (f1, s1), (f2, s2) = (similar.shingle_set(t.encode(), 5) for t in (one, two))
        meet = similar.signature(s1)[0] == similar.signature(s2)[0] or (f1 ^ f2).bit_count() <= 4
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (not meet)}
    assert sum(d != c for d, c in want.items()) > 20
    got = result(similar.near_duplicates(frame(spark, rows)), "component_id")
    assert {d: v[0] for d, v in got.items()} == want


def test_near_duplicates_right_at_the_threshold(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(60):  # 400 shared shingles; similarity 0.8 to 0.82, or 0.76 to 0.797
        own, more = fresh(404), 45 + k % 6 if k % 2 else 51 + k % 10
        rows += [(2 * k, " ".join(own + fresh(more))), (2 * k + 1, " ".join(own + fresh(more)))]
    kept = {r.doc_id for r in similar.one_of_each(frame(spark, rows)).collect()}
    assert kept == brute.one_of_each(rows) and 60 < len(kept) < 120


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999)], "u long, v long")
    assert {r.u: r.v for r in components(edges).collect()} == {**{i: 0 for i in range(1, n + 1)}, 1000: 999}


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert lines.dedup(docs, lines.build(docs)).count() == 0
    assert word_windows.remove_repeated(docs).count() == 0
    assert substrings.remove_repeated(docs).count() == 0
    assert quality.judge(docs, labels).count() == 0
    assert secrets.scan(docs.withColumn("source", F.lit("s"))).count() == 0
    assert simhash.near_duplicates(docs).count() == 0


def test_words_of_blocks():
    texts = [t for _, t in corpus()]
    got = []
    for block in T.blocks(pa.array(texts), limit=500):
        found = T.words(block)
        got += [[block.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    assert got == [brute.WORD.findall(t or "") for t in texts]


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and ORACLES.keys() <= QUERIES.keys()


def thue_morse(n, a, b):
    """2 ** n letters and their complement: a polynomial modulo 2 ** 64 has the same value for both at every odd base."""
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(2**n)), "".join(b if k.bit_count() % 2 == 0 else a for k in range(2**n))


def test_strings_that_sums_modulo_powers_of_two_confuse(spark):
    x, y = thue_morse(11, "a", "b")
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{lead} {x}"), (2, f"{lead} {y}"), (3, f"{lead} {x}"), (4, f"{x}\n{y}\n{x}"), (5, f"{y} c d e f {x} c d e f")]
    docs = frame(spark, rows)
    assert result(word_windows.remove_repeated(docs), "n_words", "n_removed", "kept_sha256") == brute.op2(rows)
    assert result(substrings.remove_repeated(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op7(rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert result(quality.judge(docs, labels), *quality.BASE) == {d: brute.op3_base(t) for d, t in rows}
    words = [f"{a} " * 20 for a in thue_morse(1, "u", "v")]  # whole windows in that order of words
    long = [(1, " ".join(thue_morse(11, "u", "v")[0])), (2, " ".join(thue_morse(11, "u", "v")[1])), (3, words[0])]
    assert result(word_windows.remove_repeated(frame(spark, long), length=2_048), "n_words", "n_removed", "kept_sha256") == brute.op2(long, 2_048)


@pytest.mark.parametrize("size", [1, 3, 8, 13, 50])
def test_window_and_span_hashes(size):
    rng = np.random.default_rng(size)
    keys = rng.integers(0, 3, 400).astype(np.uint64)
    seen = {}
    for k, h in enumerate(T.window_hashes(keys, size).tolist()):
        assert seen.setdefault(h, tuple(keys[k : k + size])) == tuple(keys[k : k + size])
    assert len(seen) == len({tuple(keys[k : k + size]) for k in range(len(keys) - size + 1)}) and len(T.window_hashes(keys[: size - 1], size)) == 0
    a, b = (rng.integers(0, 2**61 - 1, 500, np.uint64) for _ in range(2))
    assert T.product(a, b).tolist() == [int(x) * int(y) % (2**61 - 1) for x, y in zip(a, b, strict=True)]
    data = rng.integers(0, 2, 3_000).astype(np.uint8)
    at = np.arange(len(data) - size)
    told = {}
    for h, k in zip(T.span_hash(T.sums(data), at, at + size).tolist(), at.tolist(), strict=True):
        assert told.setdefault(h, data[k : k + size].tobytes()) == data[k : k + size].tobytes()
    assert len(told) == len({data[k : k + size].tobytes() for k in at.tolist()})


def test_long_spans_are_hashed_in_pieces(monkeypatch):
    data = np.random.default_rng(4).integers(0, 256, 10_000).astype(np.uint8)
    starts, ends = np.array([0, 10, 500]), np.array([9_000, 10_000, 501])
    whole = T.span_hash(T.sums(data), starts, ends)
    monkeypatch.setattr(T, "LONG", 700)
    assert (T.span_hash(T.sums(data), starts, ends) == whole).all()
    assert T.span_hash(T.sums(data[10:]), np.array([0]), np.array([9_990]))[0] == whole[1]


def test_secrets_of_a_text_with_very_many_matches(spark):
    rng = random.Random(6)
    token = lambda: "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(30))
    many = " ".join(f"token={token()}" if i % 3 else token() for i in range(100_000))
    rows = [(1, many), (2, "password: short api_key = 'abcdefgh1'"), (3, None)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    found = secrets.scan(docs)
    base = F.filter("findings", lambda m: m["kind"] < 3)
    got = {r.doc_id: r for r in found.select("doc_id", F.sha2(secrets.spans(base), 256).alias("sha"), F.size(base).alias("n"), F.size("findings").alias("all")).collect()}
    for d, t in rows:
        assert got[d].sha == brute.op6_base(t)[3] and got[d].n == sum(brute.op6_base(t)[:3])
    assert got[1].n > 60_000 and got[1]["all"] > 99_000
