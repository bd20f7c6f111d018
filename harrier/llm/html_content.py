"""Main text of pages by wrapper induction.

Every page is read once into a tree of block elements and the texts of its nodes (see dom). Pages of a host whose trees
have one shape are alike, so only the distinct shapes of a host are aligned, by simple tree matching: groups of shapes
are merged into wrappers, and these again, until each host has one wrapper. Each node of a shape then has a slot of its
host's wrapper. Over all distinct pages of the host, a slot that always holds the same text is template; slots that vary
are content or page furniture. Content is what varies within the article (or main) element, or, where a page has none,
within the smallest element that holds most of the text outside of links; menus, headers, footers, sidebars, notices,
adverts, forms and comments are left out by their element, role or class. Titles in an article are content even if they
don't vary, and an article of which nothing varies, as on a host that only holds copies of it, is content as a whole.

What the driver sees are counts. A host of very many pages is many rows of a grouping that is combined before the
shuffle, and its pages meet their shape's verdict by a broadcast of counted size, or else dealt over groups by their
count. Merging costs with the number of distinct shapes, in groups of ``GROUP`` trees.

Edge cases: null or empty html has an empty text; a null url, or one without a host, has the host ''; a page alone on its
host is judged by its own tree; repeated rows get equal results; broken markup is read as far as it goes, with elements
closed at the end; very long pages are read whole, and elements below a depth of 100 belong to the one at that depth; an
empty table gives an empty result. Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm import dom
from harrier.llm.store import col, hot_join, written

#: Trees that a task merges at once.
GROUP = 32
#: Distinct pages that must hold a text in one slot for it to be template.
TEMPLATE = 3
#: Verdicts of so many nodes may be broadcast, of a byte each.
BROADCAST = 4_000_000
#: Elements and marks that are no content.
FURNITURE = frozenset("nav aside footer header form menu dialog search fieldset".split())
MARKS = frozenset("hidden ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside complementary widget related recommended header masthead banner footer contentinfo copyright comment comments reply replies respond disqus feedback share sharing social login search toolbar skip tags".split())
#: Marks of articles and titles that are not the page's own.
ASIDE = frozenset("comment comments reply related".split())
#: Marks of the article itself, and of its title, beside which those above mean parts of it.
ARTICLE = frozenset("article post entry story articlebody".split())
PAGE = "c0 {id}, url string, host string, shape string, tree string, hashes array<bigint>, chars array<bigint>, links array<bigint>, blocks array<struct<node:int,text:string>>"


def host_of(url: Column) -> Column:
    """Host of a url without user, port and case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def opened(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page with its shape (hash of the tree), tree, blocks, and for each node the hash and length of its text."""
    schema = PAGE.format(id=pages.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, blocks = dom.read(batch.column(3)[i].as_py() or "")
                text = dom.text_of(tree)
                n = text.count('["')
                own: list[list[str]] = [[] for _ in range(n)]
                chars, links = [0] * n, [0] * n
                for node, block, linked in blocks:
                    own[node].append(block)
                    chars[node] += len(block)
                    links[node] += linked
                hashes = [xxhash.xxh64_intdigest("\n".join(o)) - 2**63 if o else 0 for o in own]
                shape = xxhash.xxh128_hexdigest(text)
                row = [[shape], [text], [hashes], [chars], [links], [[{"node": n, "text": t} for n, t, _ in blocks]]]
                kinds = [pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(3)], *[pa.array(v, k) for v, k in zip(row, kinds, strict=True)]], names=["c0", "url", "host", "shape", "tree", "hashes", "chars", "links", "blocks"])

    rows = pages.select(col(id_col).alias("c0"), col(url_col).cast("string").alias("url"), host_of(col(url_col)).alias("host"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, schema)


def wrappers(shapes: DataFrame, group: int = GROUP) -> DataFrame:
    """host, tree: the merged trees of each host's shapes."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "tree"], ascending=[False, True])
        trees = [json.loads(t) for t in rows["tree"]]
        whole = trees[0]
        for tree in trees[1:]:
            whole = dom.merge(whole, tree)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [dom.text_of(whole)], "pages": [int(rows["pages"].sum())]})

    trees = shapes.select("host", "tree", "pages")
    sizes = written(trees.groupBy("host").agg(F.count("*").alias("n")), "host-shapes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        dealt = hot_join(trees, sizes, ["host"], "tree", "n", "host-groups") if most > group else trees.join(sizes, "host")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / group)))
        trees = written(dealt.groupBy("host", "part").applyInPandas(merged, "host string, tree string, pages long"), "wrappers")
        sizes = written(trees.groupBy("host").agg(F.count("*").alias("n")), "host-shapes")
        fewer = sizes.agg(F.max("n")).first()[0] or 0
        group, most = group if fewer < most else 2 * group, fewer
    return trees.select("host", "tree")


def slotted(shapes: DataFrame, wrapped: DataFrame) -> DataFrame:
    """shapes with slots: the wrapper's node of each node."""
    held = wrapped.withColumnRenamed("tree", "wrapper").join(shapes.groupBy("host").agg(F.count("*").alias("n")), "host")
    joined = hot_join(shapes, held, ["host"], "shape", "n", "host-wrappers").select("host", "shape", "tree", "pages", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [dom.places(json.loads(w), json.loads(t)) for w, t in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(slots, pa.list_(pa.int32()))], names=["host", "shape", "tree", "pages", "slots"])

    return joined.mapInArrow(run, "host string, shape string, tree string, pages long, slots array<int>")


def furniture(node: list, within: bool, holds: bool) -> bool:
    """Whether a node is no content. within: an article or main element is around it; holds: the page's own is in it."""
    tag, words = node[0], set(node[1].split())
    if "hidden" in words:
        return True
    if tag in ("body", "main", "article", "h1") and not words & ASIDE:
        return False
    if tag == "header" and within:
        return False
    if tag in FURNITURE or words & MARKS:
        return not holds and not (words & ARTICLE and words & MARKS <= {"header"})
    return False


def verdict(tree: list, pages: list[int], same: list[bool], chars: list[int], links: list[int]) -> list[bool]:
    """Which nodes of a shape are content, given for each what its slot holds on all pages of the host."""
    nodes: list[tuple[list, int, int, bool]] = []  # node, parent, end of its part of the preorder, furniture

    def count(node: list) -> dict[str, int]:
        """Articles, main elements and titles within a node."""
        out = dict.fromkeys(("main", "article", "h1"), 0)
        for kid in node[2]:
            for tag, n in count(kid).items():
                out[tag] += n + (kid[0] == tag and not ASIDE & set(kid[1].split()))
        return out

    whole = count(tree)
    kind = next((tag for tag in ("main", "article", "h1") if whole[tag]), None)

    def holds(node: list) -> bool:
        """The page's main element, or all of its articles, or else all its titles: not some teasers alone."""
        return any(n and n == whole[tag] for tag, n in count(node).items() if tag in ((kind, "article") if kind == "main" else (kind,)))

    def walk(node: list, parent: int, within: bool, out: bool) -> None:
        number = len(nodes)
        out = out or furniture(node, within, holds(node))
        nodes.append((node, parent, 0, out))
        for kid in node[2]:
            walk(kid, number, within or node[0] in ("article", "main"), out)
        nodes[number] = (node, parent, len(nodes), out)

    walk(tree, -1, False, False)
    every = range(len(nodes))
    inside: set[int] = set()
    for tag in ("article", "main"):
        for k in every:
            node, _, end, out = nodes[k]
            words = set(node[1].split())
            if not out and (node[0] == tag or (tag in words and node[0] != "body") or "articlebody" in words) and any(chars[i] for i in range(k, end) if not nodes[i][3]):
                inside |= {*range(k, end)}
        if inside:
            break
    template = [pages[k] >= TEMPLATE and same[k] for k in every]
    own = {k for k in inside if chars[k] and not nodes[k][3]}
    if not inside:
        score = [0 if nodes[k][3] or template[k] else max(0, chars[k] - 2 * links[k]) for k in every]
        total = [sum(score[k : nodes[k][2]]) for k in every]
        at = 0
        while True:
            kids = [k for k in range(at + 1, nodes[at][2]) if nodes[k][1] == at and nodes[k][0][0] not in dom.FLOW and nodes[k][0][0] != "h1"]
            best = max(kids, key=lambda k: total[k], default=None)
            if best is None or total[best] < 0.8 * total[at] or not total[best]:
                break
            at = best
        own = {k for k in range(at, nodes[at][2]) if chars[k] and not nodes[k][3] and 2 * links[k] <= chars[k]}
        own |= {k for k in every if nodes[k][0][0] == "h1" and chars[k] and not nodes[k][3] and not template[k]}
    varying = {k for k in own if not template[k]}
    if varying:
        own = {k for k in own if not template[k] or (k in inside and nodes[k][0][0] == "h1")}
    return [k in own for k in every]


def judged(shapes: DataFrame, slots: DataFrame) -> DataFrame:
    """host, shape, pages, content: for each node of the shape whether its text is content."""
    of_host = slots.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("holding", "same", "chars", "links")))).alias("told"))
    held = of_host.join(shapes.groupBy("host").agg(F.count("*").alias("n")), "host")
    joined = hot_join(shapes, held, ["host"], "shape", "n", "host-slots")
    told = F.transform("slots", lambda s: F.col("told")[s])
    rows = joined.select("host", "shape", "pages", "tree", told.alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for tree, told in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                told = [t or {"holding": 0, "same": False, "chars": 0, "links": 0} for t in told]
                content.append(verdict(json.loads(tree), *[[t[k] for t in told] for k in ("holding", "same", "chars", "links")]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(content, pa.list_(pa.bool_()))], names=["host", "shape", "pages", "content"])

    return rows.mapInArrow(run, "host string, shape string, pages long, content array<boolean>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP, broadcast: int = BROADCAST) -> DataFrame:
    """Id, url, text (blocks of the main text, one a line) and n_chars of every page."""
    seen = written(opened(pages, id_col, url_col, html_col), "pages")
    shapes = written(seen.groupBy("host", "shape").agg(F.first("tree").alias("tree"), F.count("*").alias("pages")), "shapes")
    shapes = written(slotted(shapes, wrappers(shapes, group)), "slotted")
    # pages of equal texts count once: copies are no evidence of a template
    distinct = seen.groupBy("host", "shape", F.col("hashes")).agg(F.first("chars").alias("chars"), F.first("links").alias("links"))
    known = shapes.select("host", "shape", "slots", "pages")
    wide = shapes.agg(F.sum(F.size("slots"))).first()[0] or 0
    small = wide <= broadcast
    placed = distinct.join(F.broadcast(known), ["host", "shape"]) if small else hot_join(distinct, known, ["host", "shape"], "hashes", "pages", "page-slots")
    texts = placed.select("host", F.explode(F.arrays_zip("slots", "hashes", "chars", "links")).alias("t")).filter("t.slots >= 0 and t.chars > 0")
    slots = texts.groupBy("host", F.col("t.slots").alias("slot")).agg(F.count("*").alias("holding"), (F.min("t.hashes") == F.max("t.hashes")).alias("same"), F.sum("t.chars").alias("chars"), F.sum("t.links").alias("links"))
    told = written(judged(shapes, slots), "content")
    rows = seen.select("c0", "url", "host", "shape", "blocks")
    rows = rows.join(F.broadcast(told), ["host", "shape"]) if small else hot_join(rows, told, ["host", "shape"], "blocks", "pages", "page-content")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.col("content")[b["node"]]), lambda b: b["text"]), "\n")
    return rows.select(F.col("c0").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
