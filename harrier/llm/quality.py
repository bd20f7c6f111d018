"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Rule statistics come from the bytes of the whole text. Every tree is grown on all clean labelled rows, level by level:
a pass over their statistics counts the rows of each node and finds the extremes of the node's random feature, between
which its cut falls. A row's score is 2 ** (-mean path length / c), near 1 for rows that random splits set apart
early. Words, lines and windows of a text are told apart by 61 bits of hash (see textops.span_hash). The threshold is
the score that best separates all rejected from all clean labels, at a stated price of a clean row; below it all rows
pass. Every row of the table is scored with the same trees. What the driver holds is the trees: ``TREES`` times
2 ** ``DEPTH`` nodes, whatever the number of labels.

Edge cases: a null or empty text has no words, so all counts are 0 and it fails the base rules; labels that are
null are left out, of labels repeated for a key the lowest counts; keys of documents and labels meet as strings;
without clean and rejected labels there is no threshold and the base rules decide alone; repeated rows get equal
results; an empty table gives an empty result; other columns are kept by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm import textops as T
from harrier.llm.store import col, map_rows, written
from harrier.operators.ranking import running

TREES = 100
#: Splits on the longest path of a tree; rows that are left together there count by their number, as usual for such trees.
DEPTH = 10
#: What rejecting a share of the clean rows costs against catching the same share of the bad ones.
CLEAN_PRICE = 20.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest looks at: symbols, capital letters and exclamation marks among the characters in words, words equal
#: to the one before, lines equal to an earlier one, words in repeated windows, and the mean length of words. Each is
#: a share (but for the last) under a square root, which gives small shares room to differ.
FEATURES = ("symbols", "upper", "bangs", "repeat_next", "dup_lines", "repeat_words", "word_length")


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(block: T.Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text of a block, and its features for the forest (rows are texts)."""
    data, bounds = block.data, block.bounds
    found = T.words(block)
    n = np.diff(found.bounds)
    sums = T.sums(data)
    texts = found.texts()
    salt = T.mix(np.arange(1, len(block) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = T.span_hash(sums, found.starts, found.ends)
    heads = (data & 0xC0) != 0x80
    inside = ~T.SPACE[data]
    word_chars = T.per_text(heads & inside, bounds)
    symbols = T.per_text(SYMBOLS[data], bounds)
    # lines: ended by \n or by the text's end
    last = bounds[1:][bounds[1:] > bounds[:-1]]
    stops = np.sort(np.concatenate([np.flatnonzero(data == 10), last])) if len(data) else np.zeros(0, np.int64)
    owner = np.searchsorted(bounds, stops, "left") - 1
    starts = np.zeros(len(stops), np.int64)
    if len(stops):
        nl = np.zeros(len(data) + 1, bool)
        nl[:-1] = data == 10
        starts[1:] = stops[:-1] + nl[stops[:-1]]
        starts = np.maximum(starts, bounds[owner])
    with_word = np.searchsorted(found.starts, stops) > np.searchsorted(found.starts, starts)
    line_keys = (T.span_hash(sums, starts, stops) ^ salt[owner])[with_word]
    line_owner = owner[with_word]
    n_lines = np.bincount(line_owner, minlength=len(block))
    _, first = np.unique(line_keys, return_index=True)
    dup_lines = n_lines - np.bincount(line_owner[first], minlength=len(block))
    windows = T.window_hashes(hashes, 5)
    fits = texts[: len(windows)] == texts[4:] if len(windows) else np.zeros(0, bool)
    where = np.flatnonzero(fits)
    again = where[_repeats(windows[where] ^ salt[texts[where]])]
    repeat_words = T.per_text(T.covered(again, again + 5, len(found)), found.bounds)
    base = dict(zip(BASE, (n, word_chars, symbols, dup_lines, repeat_words), strict=True))

    chars = np.maximum(1, word_chars)
    next_same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1]))
    rates = [
        symbols / chars,
        T.per_text((data >= 65) & (data <= 90), bounds) / chars,
        T.per_text(data == 33, bounds) / chars,
        np.bincount(texts[next_same], minlength=len(block)) / np.maximum(1, n),
        dup_lines / np.maximum(1, n_lines),
        repeat_words / np.maximum(1, n),
        word_chars / np.maximum(1, n),
    ]
    return base, np.sqrt(np.column_stack(rates).astype(np.float64)) if len(block) else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Whole trees of equal depth by arrays: feature and value of nodes, path length at the last level.

    Node i has the kids 2 i + 1 and 2 i + 2. Where a tree ends early, its values are infinite down to the last level.
    """

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    usual: float
    threshold: float | None

    @property
    def trees(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Feature (-1 at a leaf), value, kids and path length at a leaf, of the nodes of each tree."""
        leaves = self.length.shape[1]
        inner = np.arange(leaves - 1)
        pad = lambda a, fill: np.concatenate([a, np.full(leaves, fill, a.dtype)])
        return [(pad(f, -1), pad(v, 0.0), pad(2 * inner + 1, 0), pad(2 * inner + 2, 0), np.concatenate([np.zeros(leaves - 1), n])) for f, v, n in zip(self.feature, self.value, self.length, strict=True)]

    def reached(self, x: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """For each tree, the place within the level that each row gets to."""
        flat, rows = np.ascontiguousarray(x.T).ravel(), np.arange(len(x))
        for feature, value in zip(self.feature, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for d in range(level):
                node = at + (2**d - 1)
                at = 2 * at + (flat[feature[node] * len(x) + rows] >= value[node])
            yield at

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for length, at in zip(self.length, self.reached(x, self.length.shape[1].bit_length() - 1), strict=True):
            total += length[at]
        return 2.0 ** (-total / max(1, len(self.length)) / self.usual)


#: Rows, and least and largest value of the node's feature, of each tree's nodes on a level.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def look(forest: Forest, x: np.ndarray, level: int, chosen: np.ndarray | None = None) -> Level:
    """What nodes of a level hold of the rows of x, or of those that are chosen for each tree."""
    shape = len(forest.feature), 2**level
    n, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
    for t, at in enumerate(forest.reached(x, level)):
        rows = np.arange(len(x)) if chosen is None else chosen[t]
        at = at[rows]
        n[t] = np.bincount(at, minlength=2**level)
        if 2**level <= forest.feature.shape[1]:
            own = x[rows, forest.feature[t, at + (2**level - 1)]]
            np.minimum.at(low[t], at, own)
            np.maximum.at(high[t], at, own)
    return n, low, high


def raised(see: Callable[[Forest, int], Level], size: int, span: np.ndarray, seed: int, trees: int, depth: int) -> Forest:
    """Trees by random features at random values, over the rows that ``see`` looks at.

    A cut may fall up to a quarter of the feature's span over all labelled rows beyond the node's own values, so
    that rows outside what is usual are set apart soon, also by features that hardly vary among usual rows.
    """
    rng = np.random.default_rng(seed)
    usable = np.flatnonzero(span > 0)
    feature = rng.choice(usable, (trees, 2**depth - 1)) if len(usable) else np.zeros((trees, 2**depth - 1), np.int64)
    share = rng.random(feature.shape)
    forest = Forest(feature, np.full(feature.shape, np.inf), np.zeros((trees, 2**depth)), max(usual_path(size), 1e-9), None)
    ended = np.full((trees, 1), -1)  # the depth at which a tree ended on the way to a node, or -1
    for level in range(depth):
        n, low, high = see(forest, level)
        ended = np.where((ended < 0) & ((n < 2) | (len(usable) == 0)), level, ended)
        here = slice(2**level - 1, 2 ** (level + 1) - 1)
        goes = ended < 0
        low, high, beyond = np.where(goes, low, 0.0), np.where(goes, high, 0.0), span[feature[:, here]] / 4
        forest.value[:, here] = np.where(goes, low - beyond + share[:, here] * (high - low + 2 * beyond), np.inf)
        ended = np.repeat(ended, 2, axis=1)
    n = see(forest, depth)[0]
    counts, which = np.unique(n, return_inverse=True)
    forest.length[:] = np.where(ended < 0, depth, ended) + np.array([usual_path(int(c)) for c in counts])[which.reshape(n.shape)]
    return forest


def grow(x: np.ndarray, span: np.ndarray, seed: int = 7, trees: int = TREES, sample: int | None = None) -> Forest:
    """Trees over rows at hand; with ``sample``, each over so many of them."""
    size = len(x) if sample is None else min(sample, len(x))
    rng = np.random.default_rng(seed + 1)
    chosen = None if size == len(x) else np.array([rng.choice(len(x), size, replace=False) for _ in range(trees)])
    return raised(lambda forest, level: look(forest, x, level, chosen), size, span, seed, trees, DEPTH)


def grow_on(rows: DataFrame, size: int, span: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """The trees that ``grow`` gives for all values of the column x, which stay in their tasks."""

    def see(forest: Forest, level: int) -> Level:
        held = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                n, low, high = look(held.value, _matrix(batch.column(0)), level)
                total = (n, low, high) if total is None else (total[0] + n, np.minimum(total[1], low), np.maximum(total[2], high))
            if total is not None:
                at = np.flatnonzero(total[0])
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(a.ravel()[at]) for a in total]], names=["node", "n", "low", "high"])

        found = rows.select("x").mapInArrow(run, "node long, n long, low double, high double").groupBy("node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        held.destroy()
        shape = trees, 2**level
        n, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        at = found.column("node").to_numpy()
        for into, name in ((n, "n"), (low, "low"), (high, "high")):
            into.ravel()[at] = found.column(name).to_numpy()
        return n, low, high

    return raised(see, size, span, seed, trees, depth)


def calibrate(scored: DataFrame, bads: int, cleans: int, price: float = CLEAN_PRICE) -> float | None:
    """The threshold t that makes (share of bad rows with score > t) - price * (share of clean rows so) largest.

    scored has the columns score and bad; equal scores are one row of counts, summed over ranges of a sort.
    """
    counts = written(scored.groupBy("score").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("c")), "scores")
    sums = running(counts, [], [F.desc("score")], {"bads": F.col("b"), "cleans": F.col("c")})
    gain = F.col("bads") / F.lit(bads) - F.lit(price) * F.col("cleans") / F.lit(cleans)
    best = sums.agg(F.max(F.struct(gain.alias("gain"), "score")).alias("best")).first().best
    if best is None or best.gain <= 0:
        return None
    below = counts.filter(F.col("score") < F.lit(best.score)).agg(F.max("score")).first()[0]
    return (best.score + (best.score - 1e-9 if below is None else below)) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base counts, failed and x (the features) of every row, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                base, x = statistics(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), *[pa.array(base[b], pa.int64()) for b in BASE], pa.array(base_failed(base)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", *BASE, "failed", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, f"id {kind}, {', '.join(f'{b} long' for b in BASE)}, failed boolean, x array<double>")


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def fit(known: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", seed: int = 7) -> Forest | None:
    """The forest from all labelled rows of ``facts``. Rows that fail the base rules take no part."""
    marked = labels.filter(col(quality_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).cast("string").alias("key")).agg((F.min(col(quality_col)).cast("int") < 1).alias("bad"))
    rows = written(known.filter("not failed").select(F.col("id").cast("string").alias("key"), "x").join(marked, "key").select("bad", "x"), "labelled")
    least, most = ([f(F.col("x")[i]) for i in range(len(FEATURES))] for f in (F.min, F.max))
    bads, cleans, *ends = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad")), *least, *most).first()
    if not cleans:
        return None
    low, high = np.array(ends, np.float64).reshape(2, len(FEATURES))
    forest = grow_on(rows.filter("not bad"), cleans, high - low, seed)
    if bads:
        held = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(_matrix(batch.column(1))))], names=["bad", "score"])

        forest.threshold = calibrate(rows.mapInArrow(run, "bad boolean, score double"), bads, cleans)
    return forest


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Key, base counts, base_failed, kept and score of each row. kept: the base rules and the forest both pass it."""
    known = written(facts(docs, id_col, text_col), "facts")
    held = docs.sparkSession.sparkContext.broadcast(fit(known, labels, id_col, quality_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, failed, x = batch.columns
            kept, scores = verdicts(np.asarray(failed.to_numpy(zero_copy_only=False), bool), _matrix(x), held.value)
            yield pa.RecordBatch.from_arrays([*rest, failed, pa.array(kept), pa.array(scores)], names=["id", *BASE, "base_failed", "kept", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    judged = known.mapInArrow(run, f"id {kind}, {', '.join(f'{b} long' for b in BASE)}, base_failed boolean, kept boolean, score double")
    return judged.toDF(id_col, *judged.columns[1:])


def verdicts(failed: np.ndarray, x: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the scores of all."""
    scores = np.zeros(len(x)) if forest is None else forest.scores(x)
    odd = np.zeros(len(x), bool) if forest is None or forest.threshold is None else scores > forest.threshold
    return ~failed & ~odd, scores


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """The rows that are kept, with all their columns."""
    known = written(facts(docs, id_col, text_col), "facts")
    held = docs.sparkSession.sparkContext.broadcast(fit(known, labels, id_col, quality_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for block in T.blocks(batch.column(at)):
                base, x = statistics(block)
                keep[block.first : block.first + len(block)] = verdicts(base_failed(base), x, held.value)[0]
            yield batch.filter(pa.array(keep))

    return map_rows(docs, run)
