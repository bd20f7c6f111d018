"""Operators 11 to 13 against plain Python: codes, audits and main texts, with their hard cases."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrier.llm import dom, filter_audit, html_content, vector_codes

#: Names that the operators use for themselves.
NAMES = ("row", "part", "of", "spread", "id", "x", "n", "host", "tree", "a b.c`d")


def extra(*names):
    return {c: F.lit(1) for c in (*NAMES, *names)}


# --- codes ---------------------------------------------------------------------------------------------------------


def codes(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd rounds over Python numbers."""
    kept = sorted(((i is None, i or 0), [math.floor(x * 1024) for x in v], label, i) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return {}, hashlib.sha256(b"").hexdigest()
    size = len(kept[0][1]) // parts
    cut = [[k[1][p * size : (p + 1) * size] for k in kept] for p in range(parts)]
    books = [[list(v) for v in own[:entries]] for own in cut]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut[p]:
                held.setdefault(near(v, books[p])[1], []).append(v)
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for k, row in enumerate(kept):
        best = [near(cut[p][k], books[p]) for p in range(parts)]
        out.setdefault((row[3], tuple(row[1])), ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), row[2]))
    sums = {}
    for row in kept:
        sums[row[2]] = sums.get(row[2], 0) + out[row[3], tuple(row[1])][1]
    return {k: (c, e, sums[label]) for k, (c, e, label) in out.items()}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 2) for i in range(60)]  # one vector many times
    rows += [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [1.0] * 7 + [None], 1), (2003, [float("inf")] + [0.0] * 7, 1), (None, [0.1] * 8, None)]
    rows[3] = (rows[2][0], rows[3][1], 1)  # an id twice
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, entries", [(4_096, 256), (50, 16)])
def test_codes_equal_plain_rounds(spark, chunk, entries):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns(extra())
    got = vector_codes.compress(frame, entries=entries, chunk=chunk).collect()
    want, books = codes(rows, entries=entries)
    assert {r.codebooks_sha256 for r in got} == {books}
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got) == sorted(str((i, *want[i, tuple(math.floor(x * 1024) for x in v)])) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))


def test_codes_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    one = vector_codes.compress(spark.createDataFrame([(5, [1.0, -1.5, 0.0, 2.0], None)], schema)).first()
    assert (one.vec_id, one.code, one.error, one.label_error) == (5, "00000000", 0, 0)
    assert one.codebooks_sha256 == hashlib.sha256(b"1024,-1536,0,2048").hexdigest()
    assert vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], schema)).select("code", "error").distinct().collect() == [("00000000", 0)]
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e300] * 4, 1)], schema))


@pytest.mark.parametrize("n, width, high", [(1, 4, 10), (700, 4, 3), (3_000, 2, 40), (900, 16, 300), (300, 3, 2**29)])
def test_filtering_gives_the_nearest_entry(n, width, high):
    rng = np.random.default_rng(n)
    points = rng.integers(-high, high, (n, width)).astype(vector_codes.exact(high + 1, width))
    points[: n // 3] = points[0]
    book = points[rng.integers(0, n, min(n, 64))]
    tree = vector_codes.Tree.of(points[vector_codes.tree_order(points)])
    assert sorted(map(tuple, tree.points.tolist())) == sorted(map(tuple, points.tolist()))
    nearest, sums, counts, whole = tree.assign(book)
    away = (tree.points.astype(np.int64)[:, None, :] - book.astype(np.int64)[None]) ** 2
    want = away.sum(2).argmin(1)
    assert (nearest == want).all() and (counts == np.bincount(want, minlength=len(book))).all()
    assert (sums == np.array([tree.points[want == k].sum(0) for k in range(len(book))])).all()
    if n > 500 and width < 5:
        assert whole > 0  # subtrees went as a whole


# --- audit ---------------------------------------------------------------------------------------------------------


def audit(docs, labels):
    marks = {}
    for d, q, t in labels:
        if d is not None:
            a, b = marks.get(d, (False, False))
            marks[d] = (a or q == 1, b or t == 1)
    failed = []
    for d, text, source in docs:
        text, f = text or "", set()
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if any(i is not None and (d is None or i < d) and (t or "") == text for i, t, _ in docs) else set()
        failed.append((source or "", f, *marks.get(d, (False, False))))
    out = {}
    removed = {}
    for part in {x[0] for x in failed}:
        own = [x for x in failed if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = [f, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, removed[k[0], v[0]]) for k, v in out.items()}


def documents():
    rng = random.Random(4)
    texts = [None, "", "UPPER CASE", "few words", "a#b " * 250, " ".join(f"w{i}" for i in range(210)), " ".join(f"w{i}" for i in range(210)), "same " * 300, "é" * 60 + " X", "x " * 150_000]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(80)]
    return docs + [(None, "few words", "s"), (None, "alone here", "t"), (7, "another text", "s"), (7, "another text", "s")]


def test_audit_equals_every_order_walked(spark):
    docs, labels = documents(), [(i, i % 2, i % 3) for i in range(0, 80, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (5, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).withColumns(extra("A", "E", "subset", "rows"))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("good", "labelled", "part")})
    got = filter_audit.audit(frame, marked)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()} == audit(docs, labels)
    assert got.count() == 3 * 600


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    some = spark.createDataFrame([(1, None, None)], docs.schema)
    assert filter_audit.audit(some, labels).count() == 600


# --- pages ---------------------------------------------------------------------------------------------------------


def semantic(rng, n, title, body):
    """Menus, an advert, an article with a header and comments, a sidebar, a form and a footer, by their elements."""
    return (
        f"<!doctype html><html><head><title>{title} - Site</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body class='page-{n} no-sidebar'>"
        f"<header class=site-header><a href=/>Site {n}</a></header><nav><ul>{''.join(f'<li><a href=/{k}>Link {rng.random()}</a>' for k in range(3))}</ul></nav>"
        f"<!-- ad --><div class='ad-slot'>Buy {rng.random()}</div><article id='post-{n}'><header><h1>{title}</h1></header>{body}<aside>See {rng.random()}</aside></article>"
        f"<section id=comments><h2>Comments</h2><div class=comment><p>I agree {rng.random()}</div></section><form><p>Your mail {n}</form><footer>&copy; {rng.random()}</footer></body></html>"
    )


def opaque(rng, n, title, body):
    """No element tells the text: tables of links and notices are the same on all pages or hold nothing but links."""
    return (
        f"<body><div><div>Welcome to our site, which is the best of all sites there are and has been so for years</div><div>{''.join(f'<a href=/{k}>{rng.choice(["cats", "dogs", "birds"])} and more of them</a> ' for k in range(9))}</div></div>"
        f"<div><div><h1>{title}</h1>{body}</div><div>All rights are reserved by the people who wrote it, as the law of our land has it</div></div>"
    )


def body(rng):
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(k))
    blocks, html = [], []
    for _ in range(rng.randint(2, 6)):
        kind, text = rng.choice(["p", "p", "p", "ul", "h2", "open"]), words(rng.randint(8, 40))
        if kind == "ul":
            blocks += [text, "x &"]
            html.append(f"<ul><li>{text}<li> x &amp;\n</ul>")
        elif kind == "open":
            blocks.append(f"{text} end")
            html.append(f"<p><b>{text.replace(' ', '  ' + chr(10))}<br>end</b>")
        else:
            blocks.append(text)
            html.append(f"<{kind}>{text}</{kind}>")
    return blocks, "".join(html)


@pytest.fixture(scope="module")
def site():
    """Rows of pages and their main texts, over hosts of several templates and sizes."""
    rng, rows, want = random.Random(8), [], {}
    for host, make, n in (("https://News.example.com:80/a", semantic, 40), ("http://blog.example.org/x", opaque, 25), ("http://one.example.net/", semantic, 1)):
        for k in range(n):
            blocks, html = body(rng)
            title = f"Title {rng.random()}"
            rows.append((len(rows), f"{host}/{k}?q=1", make(rng, k, title, html)))
            want[rows[-1][0]] = "\n".join([title, *blocks])
    copies = "<nav>m</nav><article><h1>One</h1><p>and the same</p></article>"
    rows += [(len(rows) + i, "http://copies.example.com/", copies + f"<footer>{i}</footer>") for i in range(5)]
    want |= {r[0]: "One\nand the same" for r in rows[-5:]}
    return rows, want


@pytest.mark.parametrize("group, broadcast", [(32, 4_000_000), (3, 0)])
def test_main_texts(spark, site, group, broadcast):
    rows, want = site
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns(extra("shape", "blocks", "c0", "text"))
    got = html_content.extract(frame, group=group, broadcast=broadcast)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == want
    assert got.filter("n_chars != length(text)").count() == 0


def test_pages_of_hard_kinds(spark):
    deep = "<div>" * 3_000 + "<p>deep down" + "</div>" * 3_000
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain text  only\n here"), (4, None, deep), (5, "http://a.b/", "<p>cut off <b"), (6, "http://a.b/", "a < b & c <!-- open"), (6, "http://a.b/", "a < b & c <!-- open"), (7, "http://a.b/", "<article>" + "<p>x" * 50_000), (8, "http://a.b/", "<![CDATA[x]]><p>y</p></p></div><script>never closed"), (9, "http://a.b/", "<article hidden><p>no</article><main><p>yes &copy &#x41; &bogus;</main>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_content.extract(frame).collect()}
    assert got == {1: "", 2: "", 3: "plain text only here", 4: "deep down", 5: "cut off", 6: "a < b & c", 7: "\n".join(["x"] * 50_000), 8: "y", 9: "yes © A &bogus;"}
    assert html_content.extract(frame.limit(0)).collect() == []


def test_teasers_and_wrapped_pages(spark):
    teasers = "<section class=related><h2>More</h2><article><h1>Other</h1><p>teaser</article></section><aside><article><p>aside</article></aside>"
    rows = [
        (1, "http://t.a/", f"<form id=aspnetForm><article><h1>T</h1><p>one</article>{teasers}</form>"),
        (2, "http://t.b/", f"<div class='with-sidebar'><main><h1>T</h1><p>two <nav>menu</nav></main>{teasers}</div>"),
        (3, "http://t.c/", "<div class=header-image><h1>T</h1></div><div class=post-content><p>three three three three</div><div class=sidebar><p>side</div>"),
        (4, "http://t.d/", "<article class='post has-comments-open'><header><h1>T</h1></header><p>four</article><div id=comments><article class=comment><p>mine</article></div>"),
    ]
    got = {r.page_id: r.text for r in html_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T\none", 2: "T\ntwo", 3: "T\nthree three three three", 4: "T\nfour"}


def test_host_of(spark):
    urls = ["http://User@A.b.C:8080/x", "https://a.b?c=http://d.e", "//a.b/c", None, "ftp://x#y"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(html_content.host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.b.c", "a.b", "", "", "x"]


def trees(rng, depth=3):
    return [rng.choice("abc"), "", [trees(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]


def largest(a, b):
    """Nodes of the largest matching, by trying all ordered pairings of kids."""
    if a[0] != b[0]:
        return 0
    x, y, best = a[2], b[2], 0
    for k in range(min(len(x), len(y)) + 1):
        for i in itertools.combinations(range(len(x)), k):
            for j in itertools.combinations(range(len(y)), k):
                scores = [largest(x[p], y[q]) for p, q in zip(i, j, strict=True)]
                best = max(best, sum(scores)) if all(scores) else best
    return 1 + best


def plain_matching(x, y):
    """Pairs of two long lists of leaves by the whole table of best sums."""
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            w = dom.alike(a, b)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0.0)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


@pytest.mark.parametrize("n", [5, 499, 501, 560])
def test_long_lists_of_kids_are_matched_as_short_ones(n):
    many = [["div", "card", [["p", "", []]]] for _ in range(n)]
    first, last = ["body", "", [["section", "promo", []], *many]], ["body", "", [*many, ["section", "promo", []]]]
    assert dom.match(first, last) == [(i + 1, i) for i in range(n)]
    assert len(dom.merge(first, last)[2]) == n + 2
    assert -1 not in dom.places(last, ["body", "", many])
    rng = random.Random(n)
    x, y = ([[rng.choice(["div", "nav"]), rng.choice(["a", "a b", "a b c", "d"]), []] for _ in range(n)] for _ in range(2))
    assert dom.match(["body", "", x], ["body", "", y]) == plain_matching(x, y)
    y[: n // 2] = x[: n // 2]
    assert dom.match(["body", "", x], ["body", "", y]) == plain_matching(x, y)


def test_tree_matching_and_merging():
    rng = random.Random(1)
    size = lambda t: 1 + sum(map(size, t[2]))
    for _ in range(60):
        a, b = ["r", "", trees(rng)[2]], ["r", "", trees(rng)[2]]
        assert 2 * largest(a, b) == dom._weight(a, b, {})
        whole = dom.merge(a, b)
        assert size(whole) == size(a) + size(b) - largest(a, b)
        for tree in (a, b):  # each tree lies in the whole, node by node
            places = dom.places(whole, tree)
            assert -1 not in places and len(set(places)) == size(tree)
        assert json.loads(dom.text_of(whole)) == whole
