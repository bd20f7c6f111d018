"""Pages as trees of block elements, and their alignment by simple tree matching.

A tree is (tag, marks, kids); marks are the words of class, id and role, without digits. Inline elements belong to the
text of the block around them. Elements that repeat as running text does (paragraphs, items, rows, lower headings) share
one node if they follow each other with equal tag and marks, so that pages of unequal length have trees of one shape.

Lists of kids of any length are matched by the same rule: equal kids that both lists begin with belong together, and the
rest is a table of best sums, made row by row. Only some rows are kept; those between them are made again on the way back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from html import unescape
from math import isqrt

import numpy as np

#: Elements of HTML by what they do to the text around them.
FLOW = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre ul ol dl table thead tbody tfoot caption figure figcaption hr".split())
BLOCKS = FLOW | frozenset("body div section article main nav aside header footer form h1 fieldset legend details summary center dialog menu hgroup address search".split())
UNSEEN = frozenset("script style title textarea noscript template select button iframe object svg math canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element that opens ends, if it is open within the nearest of the elements named second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
#: Elements deeper than this belong to the text of the one at this depth.
DEEPEST = 100
#: Most weights that are kept at once; beyond that they are worked out anew.
KEPT = 1_000_000
#: Elements whose text ends at their own end tag alone.
RAW = frozenset("script style title textarea iframe".split())
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARK = re.compile(r"[^a-z]+")


def marks(rest: str) -> str:
    """Words of class, id and role of a tag's attributes, sorted, and ``hidden`` where an element isn't shown."""
    out = set()
    for found in _ATTRIBUTE.finditer(rest):
        name, value = found[1].lower(), unescape(found[2] or found[3] or found[4] or "")
        if name in ("class", "id", "role", "itemprop"):
            out.update(_MARK.split(_CAMEL.sub(" ", value).lower()))
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
            out.add("hidden")
    out.discard("")
    return " ".join(sorted(out))


class _Node:
    __slots__ = ("tag", "marks", "kids", "number")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.kids, self.number = tag, marks, [], 0


class _Reader:
    """Builds the nodes of a page and its blocks: (node, text, characters within links)."""

    def __init__(self) -> None:
        self.top = _Node("body", "")
        #: Open elements with their node, or else the one around them.
        self.open: list[tuple[str, _Node, bool]] = [("body", self.top, False)]
        self.unseen, self.linked, self.words, self.links = 0, False, [], 0
        self.blocks: list[tuple[_Node, str, int]] = []

    def scan(self, html: str) -> None:
        """Markup is read as browsers do: a < that opens nothing is text, what is cut off at the end is left out."""
        at = 0
        while (lt := html.find("<", at)) >= 0:
            tag = _TAG.match(html, lt)
            if tag is None and html[lt + 1 : lt + 2] not in ("!", "?", "/") and not html[lt + 1 : lt + 2].isalpha():
                self.text(html[at : lt + 1])
                at = lt + 1
                continue
            self.text(html[at:lt])
            if tag is not None:
                name, at = tag[2].lower(), tag.end()
                if tag[1]:
                    self.end(name)
                else:
                    self.start(name, tag[3])
                    if name in RAW and self.open[-1][0] == name:
                        close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                        at = close.start() if close else len(html)
            else:
                comment = html.startswith("<!--", lt)
                close = html.find("-->" if comment else ">", lt + 2)
                at = close + (3 if comment else 1) if close >= 0 else len(html)
        self.text(html[at:])
        self.flush()

    def text(self, data: str) -> None:
        if data and not self.unseen:
            data = unescape(data) if "&" in data else data
            self.words.append(data)
            if self.linked:
                self.links += len(data)

    def flush(self) -> None:
        if self.words:
            if text := " ".join("".join(self.words).split()):
                self.blocks.append((self.open[-1][1], text, min(self.links, len(text))))
            self.words, self.links = [], 0

    def shut(self, tags: Iterable[str], within: Iterable[str]) -> None:
        """Closes the elements of the tags that are open within the nearest of the others."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in within:
                break
            if self.open[k][0] in tags:
                self.pop(k)

    def pop(self, k: int) -> None:
        self.flush()
        self.unseen -= sum(x[2] for x in self.open[k:])
        del self.open[k:]

    def start(self, tag: str, rest: str) -> None:
        if tag in UNSEEN:
            if not rest.endswith("/"):
                self.open.append((tag, self.open[-1][1], True))
                self.unseen += 1
        elif tag == "br":
            self.text(" ")
        elif tag == "a":
            self.linked = True
        elif tag == "body":
            self.flush()
        elif tag in BLOCKS:
            self.flush()
            self.linked = False
            if self.open[-1][0] == "p":
                self.pop(len(self.open) - 1)
            if tag in ENDS:
                self.shut(*ENDS[tag])
            if tag not in VOID:
                self.open.append((tag, self.node(tag, marks(rest) if rest else ""), False))

    def node(self, tag: str, mark: str) -> _Node:
        parent = self.open[-1][1]
        if len(self.open) > DEEPEST or self.unseen:
            return parent
        if tag in FLOW:
            for kid in parent.kids if parent.tag in FLOW else parent.kids[-1:]:
                if kid.tag == tag and kid.marks == mark:
                    return kid
        parent.kids.append(kid := _Node(tag, mark))
        return kid

    def end(self, tag: str) -> None:
        if tag == "a":
            self.linked = False
        elif tag in BLOCKS or tag in UNSEEN:
            self.flush()
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    self.pop(k)
                    break


def read(html: str) -> tuple[list, list[tuple[int, str, int]]]:
    """The tree of a page, and its blocks in page order: (number of the node in preorder, text, characters in links)."""
    reader = _Reader()
    reader.scan(html)
    count = 0

    def tree(node: _Node) -> list:
        nonlocal count
        node.number, count = count, count + 1
        return [node.tag, node.marks, [tree(kid) for kid in node.kids]]

    whole = tree(reader.top)
    return whole, [(node.number, text, links) for node, text, links in reader.blocks]


def text_of(tree: list) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


def alike(a: list, b: list) -> float:
    """0 for nodes that can't be the same; else 1 and the share of marks they have in common."""
    if a[0] != b[0]:
        return 0.0
    if a[1] == b[1]:
        return 2.0
    x, y = set(a[1].split()), set(b[1].split())
    same = len(x & y) / len(x | y)
    return 1.0 + same if same >= 0.5 else 0.0


def match(a: list, b: list, known: dict | None = None) -> list[tuple[int, int]]:
    """Pairs of kids of two nodes, in order: the largest matching of their trees (simple tree matching)."""
    known = {} if known is None else known
    same, base, row_of = _begun(a[2], b[2], known)
    n, m = len(a[2]) - same, len(b[2]) - same
    step = 2 * isqrt(n) + 1
    row, kept = np.full(m + 1, base), []
    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = _next(row, row_of(i))
    pairs, i, j = [], n, m
    while i and j:
        first = (i - 1) // step * step
        row, ups, lefts = kept.pop(), [], []
        for k in range(first, i):
            above, row = row, _next(row, row_of(k))
            ups.append(row == above)
            lefts.append(row[1:] == row[:-1])
        while i > first and j:
            if ups[i - 1 - first][j]:
                i -= 1
            elif lefts[i - 1 - first][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((same + i, same + j))
    return [(k, k) for k in range(same)] + pairs[::-1]


def _kind(node: list, known: dict) -> tuple[int, int]:
    """What nodes of equal tag, marks and kids share: a number, and how many nodes they hold."""
    if id(node) not in known:
        kids = tuple(_kind(kid, known) for kid in node[2])
        shape = node[0], node[1], kids
        if shape not in known:
            known[shape] = len(known), 1 + sum(k[1] for k in kids)
        known[id(node)] = known[shape]
    return known[id(node)]


def _weight(a: list, b: list, known: dict) -> float:
    """Matched nodes of two trees, weighed by their marks; 0 if their tops don't match."""
    key = _kind(a, known), _kind(b, known)
    if key[0] == key[1]:
        return 2.0 * key[0][1]
    own = alike(a, b)
    if not (own and a[2] and b[2]):
        return own
    weights = known.setdefault("weights", {})
    if key not in weights:
        same, row, row_of = _begun(a[2], b[2], known)
        row = np.full(len(b[2]) - same + 1, row)
        for i in range(len(a[2]) - same):
            row = _next(row, row_of(i))
        if len(weights) >= KEPT:
            weights.clear()
        weights[key] = own + float(row[-1])
    return weights[key]


def _begun(x: list, y: list, known: dict) -> tuple[int, float, Callable[[int], np.ndarray]]:
    """How many equal kids both lists begin with, their weight, and the weights of a later kid of x with the rest of y.

    A kid weighs most with its equal, so the first kids of both lists are a pair of the largest matching if they are equal.
    """
    left, right = [_kind(kid, known) for kid in x], [_kind(kid, known) for kid in y]
    same = 0
    while same < min(len(x), len(y)) and left[same] == right[same]:
        same += 1
    kinds = {kind: kid for kind, kid in zip(right[same:], y[same:], strict=True)}
    turn = {kind: k for k, kind in enumerate(kinds)}
    at = np.array([turn[kind] for kind in right[same:]], np.int64)
    rows: dict[tuple[int, int], np.ndarray] = {}

    def row_of(i: int) -> np.ndarray:
        kind = left[same + i]
        if kind not in rows:
            if len(rows) * len(kinds) >= KEPT:
                rows.clear()
            rows[kind] = np.array([_weight(x[same + i], kid, known) for kid in kinds.values()])
        return rows[kind][at]

    return same, sum((2.0 * kind[1] for kind in left[:same]), 0.0), row_of


def _next(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of best sums: a kid of x is left out, or paired with one of y, or that one is left out."""
    row = above.copy()
    np.maximum(row[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row)


def merge(a: list, b: list, known: dict | None = None) -> list:
    """One tree that holds both: matched nodes once, others of b after the one they follow."""
    known = {} if known is None else known
    pairs = dict((j, i) for i, j in match(a, b, known))
    kids, i = [], 0
    for j, kid in enumerate(b[2]):
        if j in pairs:
            kids += a[2][i : pairs[j]]
            kids.append(merge(a[2][pairs[j]], kid, known))
            i = pairs[j] + 1
        else:
            kids.append(kid)
    return [a[0], a[1], kids + a[2][i:]]


def places(wrapper: list, tree: list) -> list[int]:
    """For each node of a tree, in preorder, the node of the wrapper that it is aligned with, or -1."""
    sizes: dict[int, int] = {}
    known: dict = {}

    def size(node: list) -> int:
        sizes[id(node)] = 1 + sum(size(kid) for kid in node[2])
        return sizes[id(node)]

    size(wrapper)
    out: list[int] = []

    def walk(node: list, other: list | None, number: int) -> None:
        out.append(number)
        pairs = dict((i, j) for i, j in match(node, other, known)) if other is not None else {}
        starts, at = [], number + 1
        for kid in other[2] if other is not None else []:
            starts.append(at)
            at += sizes[id(kid)]
        for i, kid in enumerate(node[2]):
            walk(kid, other[2][pairs[i]], starts[pairs[i]]) if i in pairs else walk(kid, None, -1)

    walk(tree, wrapper, 0)
    return out
