"""From ranked chunks to a bounded context: neighbours, overlap merging, fitting, chunking and packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions import text as X
from harrier.operators.lexical import top_k
from harrier.operators.ranking import running
from harrier.plans.config import DEFAULTS
from harrier.sources.shared import written

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def expand_neighbors(seeds: DataFrame, corpus: DataFrame, by: list[str], source: str, index: str, window: int = DEFAULTS.neighbor_window, score: str = "score") -> DataFrame:
    """by, source, index, score, is_neighbor: seeds and the chunks of their source within ±window.

    A neighbour inherits the score of its seed; of several rows for a chunk the best score counts, and at equal score
    the genuine hit. So a hit beside a better one becomes a neighbour.
    """
    offsets = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("__off")
    spread = seeds.select(*by, source, index, score, offsets).withColumn(index, F.col(index) + F.col("__off")).withColumn("is_neighbor", F.col("__off") != 0)
    held = spread.join(corpus.select(source, index).distinct(), [source, index], "left_semi")
    best = held.groupBy(*by, source, index).agg(F.max(F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("s"), (~F.col("is_neighbor")).cast("int").alias("hit"))).alias("b"))
    return best.select(*by, source, index, F.when(F.col("b.s") != float("-inf"), F.col("b.s")).alias(score), (F.col("b.hit") == 0).alias("is_neighbor"))


def contiguous_groups(rows: DataFrame, by: list[str], index: str, same: list[str] | None = None) -> DataFrame:
    """rows with group_no: it grows where index is not the one before plus 1, or a column of ``same`` changes."""
    w = W.partitionBy(*by).orderBy(index)
    breaks = F.lag(index).over(w).isNull() | (F.col(index) != F.lag(index).over(w) + 1)
    for c in same or []:
        breaks = breaks | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("__break", breaks.cast("int")).withColumn("group_no", F.sum("__break").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__break")


def merge_overlapping(rows: DataFrame, by: list[str], index: str, text: str, score: str, same: list[str] | None = None, limit: int = DEFAULTS.overlap_limit) -> DataFrame:
    """One row for each run of contiguous chunks: joined text, first and last index, best score, members."""
    grouped = contiguous_groups(rows, by, index, same).groupBy(*by, "group_no").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("m"), F.max(score).alias(score), F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count("*").alias("members"))
    rest = F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1)))
    joined = F.aggregate(rest, F.get(F.col("m"), F.lit(0))["t"], lambda acc, x: X.join_overlapping(acc, x["t"], limit))
    return grouped.select(*by, "group_no", joined.alias(text), score, "first_index", "last_index", "members", F.when(F.col("members") == 1, F.col("first_index").cast("string")).otherwise(F.concat_ws(" .. ", F.col("first_index").cast("string"), F.col("last_index").cast("string"))).alias("label"))


def fit_chars(rows: DataFrame, by: list[str], order: list[str], text: str, source: str, limit: int = DEFAULTS.context_chars) -> DataFrame:
    """by, reference_id, source, text, truncated: numbered blocks within ``limit`` characters.

    Each block is ``[n] source`` on a line and its text; two characters part blocks. A text that does not fit is cut
    and right-trimmed, and what that frees may still hold one more block. A fold over the first rows of a group: every
    block takes at least its header and what parts it from the next, so only so many rows and characters can count.
    """
    least = len("[1] \n") + 2
    first = top_k(rows.select(*by, *order, source, F.left(F.col(text), F.lit(limit + 1)).alias(text)), by, [F.col(c) for c in order], limit // least + 1, "__n").drop("__n")
    item = F.struct(*[F.col(c) for c in order], F.col(source).alias("__s"), F.col(text).alias("__t"))
    grouped = first.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<n:int,source:string,text:string,truncated:boolean>>"
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = F.size(s["out"]) + 1
        header = F.concat(F.lit("["), n.cast("string"), F.lit("] "), x["__s"], F.lit("\n"))
        room = limit - s["used"] - F.length(header)
        cut = F.length(x["__t"]) > room
        body = F.when(cut, F.rtrim(F.substring(x["__t"], F.lit(1), F.greatest(room, F.lit(0))))).otherwise(x["__t"])
        used = s["used"] + F.length(header) + F.length(body) + 2
        made = F.struct(n.alias("n"), x["__s"].alias("source"), body.alias("text"), cut.alias("truncated"))
        return F.when(s["stop"] | (room <= 0), F.struct(s["used"].alias("used"), F.lit(True).alias("stop"), s["out"].alias("out"))).otherwise(F.struct(used.cast("int").alias("used"), (used >= limit).alias("stop"), F.array_append(s["out"], made).alias("out")))

    fitted = grouped.select(*by, F.explode(F.aggregate("items", start, step)["out"]).alias("b"))
    return fitted.select(*by, F.col("b.n").alias("reference_id"), F.col("b.source").alias(source), F.col("b.text").alias(text), F.col("b.truncated").alias("truncated"))


def fit_tokens(rows: DataFrame, by: str, order: str, text: str, limit: int = DEFAULTS.context_tokens, encode: Callable[[str], list] = str.split, decode: Callable[[list], str] = " ".join) -> DataFrame:
    """by, reference_id, text, tokens, truncated within a token budget, with an injectable tokenizer (words by default).

    Rows are counted where they are, and their tokens summed along the order by ranges (see ranking.running): a row
    stays if those before it leave room. Only the one that passes the limit is cut. ``order`` tells rows apart.
    """
    kinds = dict(rows.dtypes)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: len(encode(t)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([decode(encode(t)[:n]) for t, n in zip(texts.fillna(""), most, strict=True)], dtype=object)

    sized = rows.select(by, order, text).withColumn("tokens", counted(text))
    placed = running(sized, [by], [order], {"__upto": F.col("tokens").cast("long"), "reference_id": F.lit(1).cast("long")})
    room = limit - (F.col("__upto") - F.col("tokens"))
    kept = placed.filter(room > 0).withColumn("__room", room.cast("int"))
    over = F.col("tokens") > F.col("__room")
    body = F.when(over, cut(text, F.least("__room", "tokens"))).otherwise(F.coalesce(text, F.lit("")))
    return kept.select(F.col(by).cast(kinds[by]).alias(by), F.col("reference_id").cast("int").alias("reference_id"), body.alias(text), F.least("tokens", "__room").cast("int").alias("tokens"), over.alias("truncated"))


#: Rows of a group that one task packs.
PACKED = 65_536


def _upto(placed: DataFrame, by: list[str], value: Column, probe: Column, name: str) -> DataFrame:
    """by, __place and, for each row, how many rows of its group have a value of at most its probe.

    Values and probes are sorted together, and the values counted along that order.
    """
    values = placed.select(*by, F.lit(-1).cast("long").alias("__place"), value.alias("__v"), F.col("__place").alias("__tie"))
    probes = placed.select(*by, "__place", probe.alias("__v"), F.col("__place").alias("__tie"))
    both = values.unionByName(probes).withColumn("__asks", (F.col("__place") >= 0).cast("int"))
    counted = running(both, by, ["__v", "__asks", "__tie"], {name: (1 - F.col("__asks")).cast("long")})
    return counted.filter("__asks = 1").select(*by, "__place", name)


def pack(rows: DataFrame, by: list[str], order: list[str], size: str, limit: int, count: int | None = None, ts: str | None = None, wait: int | None = None, block: int = PACKED) -> DataFrame:
    """by, order, size, bin: in order, a new bin starts where the next row would pass a limit.

    The sizes of a bin sum to ``limit`` at most, unless a single row is larger; it has at most ``count`` rows; and where
    ``ts`` and ``wait`` (seconds) are given, which needs an order by ts, it is closed so long after its first row. Null
    sizes count as 0, and sizes must not be negative.

    Where a bin that starts at a row ends is told for every row by prefix sums; which rows do start one follows from
    these pointers. Blocks of rows follow them within a task. Between the blocks of a group the pointers out of a block
    are doubled, so a group of any size takes as many rounds as its number of blocks has digits.
    """
    by_ = [f"__by{i}" for i in range(len(by))] or ["__all"]
    keys = [F.coalesce(F.to_json(F.struct(F.col(c).alias("k"))), F.lit("")).alias(n) for c, n in zip(by, by_, strict=True)] if by else [F.lit("").alias("__all")]
    keyed = rows.select(*by, *order, F.col(size).cast("long").alias(size), *[F.col(ts).cast("timestamp").alias("__ts") for _ in [0] if ts is not None], *keys)
    keyed = written(keyed.withColumn("__n", F.coalesce(F.col(size), F.lit(0))).withColumn("__tie", F.monotonically_increasing_id()), "pack")
    placed = written(running(keyed, by_, [*order, "__tie"], {"__place": F.lit(1).cast("long"), "__sum": F.col("__n")}), "pack-placed")
    before = F.col("__sum") - F.col("__n")
    slim = placed.select(*by_, "__place", "__sum", "__n", *(["__ts"] if ts is not None else []))
    found = slim.select(*by_, "__place").join(_upto(slim, by_, F.col("__sum"), before + limit, "__fit"), [*by_, "__place"]).join(_upto(slim, by_, F.col("__sum"), before, "__empty"), [*by_, "__place"])
    next_ = F.greatest("__fit", F.col("__empty") + 1) + 1
    if count is not None:
        next_ = F.least(next_, F.col("__place") + count)
    if ts is not None and wait is not None:
        found = found.join(_upto(slim, by_, F.unix_micros("__ts"), F.unix_micros("__ts") + wait * 1_000_000, "__soon"), [*by_, "__place"])
        next_ = F.least(next_, F.col("__soon") + 1)
    pointers = written(found.select(*by_, "__place", next_.alias("__next")).withColumn("__block", F.floor((F.col("__place") - 1) / block)), "pack-pointers")

    def out_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first place beyond the block that the pointers lead to from each row."""
        pdf = pdf.sort_values("__place")
        first, next_ = int(pdf["__place"].iloc[0]), pdf["__next"].to_numpy().copy()
        for i in range(len(next_) - 1, -1, -1):
            if next_[i] - first < len(next_):
                next_[i] = next_[next_[i] - first]
        return pdf.assign(__next=next_)

    kinds = pointers.schema.simpleString().removeprefix("struct<").removesuffix(">")
    starts = pointers.filter("__place = 1").select(*by_, "__place")
    blocks = (pointers.agg(F.max("__block")).first()[0] or 0) + 1
    if blocks > 1:
        jumps = written(pointers.groupBy(*by_, "__block").applyInPandas(out_of, kinds).select(*by_, "__place", "__next"), "pack-jumps")
        for _ in range(int(blocks - 1).bit_length()):
            starts = written(starts.unionByName(starts.join(jumps, [*by_, "__place"]).select(*by_, F.col("__next").alias("__place"))).distinct(), "pack-starts")
            far = jumps.select(*by_, F.col("__place").alias("__next"), F.col("__next").alias("__far"))
            jumps = written(jumps.join(far, [*by_, "__next"]).select(*by_, "__place", F.col("__far").alias("__next")), "pack-jumps")
    entries = starts.select(*by_, F.col("__place").alias("__entry"), F.floor((F.col("__place") - 1) / block).alias("__block")).groupBy(*by_, "__block").agg(F.min("__entry").alias("__entry"))

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Bins within the block: 0 for rows of a bin that starts before it."""
        pdf = pdf.sort_values("__place")
        first, next_, entry = int(pdf["__place"].iloc[0]), pdf["__next"].to_numpy(), pdf["__entry"].iloc[0]
        start = pd.Series(0, index=pdf.index)
        at = None if pd.isna(entry) else int(entry) - first
        while at is not None and at < len(next_):
            start.iloc[at] = 1
            at = int(next_[at]) - first
        return pdf.assign(__bin=start.cumsum().astype("int64"))

    local = written(pointers.join(entries, [*by_, "__block"], "left").groupBy(*by_, "__block").applyInPandas(marked, f"{kinds}, __entry bigint, __bin bigint"), "pack-bins")
    made = local.groupBy(*by_, "__block").agg(F.max("__bin").alias("__made"))  # a row for each block
    ahead = F.coalesce(F.sum("__made").over(W.partitionBy(*by_).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = local.join(made.select(*by_, "__block", ahead.alias("__ahead")), [*by_, "__block"]).select(*by_, "__place", (F.col("__bin") + F.col("__ahead") - 1).cast("int").alias("bin"))
    return placed.join(bins, [*by_, "__place"]).select(*by, *order, size, "bin")


@dataclass(frozen=True)
class ContextPlan:
    """Which stages run between retrieval and the prompt, and their limits."""

    expand: bool = True
    merge: bool = True
    compress: bool = True
    window: int = DEFAULTS.neighbor_window
    chars: int = DEFAULTS.context_chars


def build_context(hits: DataFrame, corpus: DataFrame, plan: ContextPlan = ContextPlan(), by: str = "query_id", source: str = "source", index: str = "chunk_index", text: str = "text", score: str = "score") -> dict[str, DataFrame]:
    """hits (by, source, index, score) and the chunks (source, index, text) -> the rows after each stage.

    deduplicated: the best score of each chunk; expanded: with neighbours; merged: runs of chunks joined without their
    overlap; compressed: numbered blocks within the limit. A stage that is switched off passes its rows on.
    """
    best = hits.groupBy(by, source, index).agg(F.max(score).alias(score))
    found = expand_neighbors(best, corpus, [by], source, index, plan.window, score) if plan.expand else best.withColumn("is_neighbor", F.lit(False))
    full = found.join(corpus.select(source, index, text), [source, index])
    if plan.merge:
        merged = merge_overlapping(full, [by, source], index, text, score)
    else:
        merged = full.select(by, source, F.lit(0).alias("group_no"), text, score, F.col(index).alias("first_index"), F.col(index).alias("last_index"), F.lit(1).cast("long").alias("members"), F.col(index).cast("string").alias("label"))
    ranked = merged.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), source, "first_index")))
    if plan.compress:
        fitted = fit_chars(ranked, [by], ["place"], text, source, plan.chars)
    else:
        fitted = ranked.select(by, F.col("place").alias("reference_id"), source, text, F.lit(False).alias("truncated"))
    return {"deduplicated": best, "expanded": full, "merged": ranked, "compressed": fitted}


def split_text(text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, chunk) of a text: split at the coarsest separator that occurs, merged up to size, overlapping."""

    def merge(pieces: list[str]) -> Iterator[str]:
        held: list[str] = []
        total = 0
        for piece in pieces:
            if held and total + len(piece) > size:
                if whole := "".join(held).strip():
                    yield whole
                while held and (total > overlap or (total + len(piece) > size and total > 0)):
                    total -= len(held.pop(0))
            held.append(piece)
            total += len(piece)
        if whole := "".join(held).strip():
            yield whole

    def split(part: str, seps: tuple[str, ...]) -> Iterator[str]:
        at = next((i for i, s in enumerate(seps) if not s or s in part), len(seps) - 1)
        sep, finer = seps[at], seps[at + 1 :]
        raw = part.split(sep) if sep else list(part)
        pieces = [p for i, p in enumerate((sep + x if i else x) for i, x in enumerate(raw)) if p] if sep else raw
        held: list[str] = []
        for piece in pieces:
            if len(piece) < size:
                held.append(piece)
                continue
            yield from merge(held)
            held = []
            if finer:
                yield from split(piece, finer)
            else:
                yield piece
        yield from merge(held)

    out: list[tuple[int, str]] = []
    for chunk in split(text or "", separators):
        after = max(0, out[-1][0] + len(out[-1][1]) - overlap) if out else 0
        out.append((text.find(chunk, after), chunk))
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """doc id, source, chunk_index (running in its source), start_index, chunk_char_count, chunk_id, text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, s, i, at, len(c), c) for d, s, t in zip(pdf[id_col], pdf[source_col], pdf[text_col], strict=True) for i, (at, c) in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, source_col, "part", "start_index", "chunk_char_count", "text"])

    parts = docs.select(id_col, source_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, `{source_col}` string, part int, start_index int, chunk_char_count int, text string")
    parts = written(parts, "chunk-parts")  # the splitter runs once
    # the index runs over a source: counts of documents before, then the part within the document
    sizes = parts.groupBy(source_col, id_col).agg(F.count("*").alias("n"))
    before = running(sizes, [source_col], [id_col], {"upto": F.col("n")}).select(source_col, id_col, (F.col("upto") - F.col("n")).alias("before"))
    numbered = parts.join(before, [source_col, id_col])
    return numbered.select(id_col, source_col, (F.col("before") + F.col("part")).cast("int").alias("chunk_index"), "start_index", "chunk_char_count", "text").withColumn("chunk_id", F.concat_ws(":", F.col(source_col), F.lit("pna"), F.concat(F.lit("c"), F.col("chunk_index").cast("string"))))
