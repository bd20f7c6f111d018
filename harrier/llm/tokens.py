"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are cut into pre-tokens, distinct pre-tokens of a batch become one ragged numpy array of byte symbols, and
in every round each sequence merges all occurrences of its own lowest-ranked pair at once. Sequences without a
known pair drop out; the surviving symbols are counted. Counts of pre-tokens met before are kept in a bounded
table per task.

The vocabulary is a ``tokenizers`` JSON file of a ByteLevel BPE without normaliser, and any other file is refused; its
path is a parameter.
Special strings inside texts count as one token each, as the library does by default. A null or empty text has 0
bytes and 0 tokens; texts are never cut; every row is counted on its own, so ties and repeated rows are no
trouble; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from harrier.llm import textops as T
from harrier.llm.store import col

#: Fixed value: the pre-token pattern of the public byte-level BPE; \s there is Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pre-tokens whose counts a task remembers before it starts afresh, and the letters of the longest of them:
#: at most about 60 MB. Longer ones are counted each time.
REMEMBERED, LETTERS = 250_000, 32
#: Pre-tokens and bytes that are merged at once; a longer pre-token is merged alone.
PIECES, BYTES = 20_000, 4 << 20
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@dataclass
class Merges:
    """Merge rules as sorted arrays: pair (a, b) is key a << 32 | b, with its rank and the symbol it makes."""

    first: np.ndarray  # symbol of each byte
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    special: list[str]
    known: dict[str, int] = field(default_factory=dict)


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    odd += [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    cut = spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE: {', '.join(odd) or 'another model or pre-tokenizer'}")
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return Merges(np.array([vocab[c] for c in byte_letters()], np.int64), keys[order], order.astype(np.int64), made[order], [t["content"] for t in spec.get("added_tokens", [])])


def count_symbols(pieces: list[bytes], rules: Merges) -> np.ndarray:
    """Symbols left of each piece when no rule applies any more."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = sizes.copy()
    symbols = rules.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    while len(symbols) > 1 and len(rules.keys):
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(rules.keys, pair), len(rules.keys) - 1)
        rank = np.where((rules.keys[at] == pair) & (owner[:-1] == owner[1:]), rules.ranks[at], NEVER)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.minimum.reduceat(np.concatenate([rank, [NEVER]]), begins)
        spread = np.repeat(lowest, np.diff(np.concatenate([begins, [len(owner)]])))
        chosen = np.concatenate([(rank == spread[:-1]) & (rank != NEVER), [False]])
        # equal pairs that overlap, as in aaa: every other one from the left
        if (chosen[1:] & chosen[:-1]).any():
            where = np.flatnonzero(chosen)
            run = np.concatenate([[True], np.diff(where) > 1])
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            chosen[where[place % 2 == 1]] = False
        hit = np.flatnonzero(chosen)
        symbols[hit] = rules.made[at[hit]]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        np.subtract.at(counts, owner[hit], 1)
        stay &= spread != NEVER  # sequences without a known pair are done
        symbols, owner = symbols[stay], owner[stay]
    return counts


def _batches(pieces: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Pieces with their bytes, some at a time."""
    names, coded, size = [], [], 0
    for piece in pieces:
        data = piece.encode()
        if names and (len(names) == PIECES or size + len(data) > BYTES):
            yield names, coded
            names, coded, size = [], [], 0
        names.append(piece)
        coded.append(data)
        size += len(data)
    if names:
        yield names, coded


def piece_counts(pieces: list[str], rules: Merges) -> np.ndarray:
    """Tokens of each pre-token, by the rules and what the task remembers."""
    asked = {*pieces}
    short = {p for p in asked if len(p) <= LETTERS}
    if len(rules.known) + len(short) > REMEMBERED:
        rules.known.clear()
    counts = {p: rules.known[p] for p in short & rules.known.keys()}
    for names, coded in _batches(sorted(asked - counts.keys())):
        counts.update(zip(names, count_symbols(coded, rules).tolist(), strict=True))
    if len(short) <= REMEMBERED:
        rules.known.update((p, counts[p]) for p in short)
    return np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))


def text_counts(texts: list[str], rules: Merges) -> list[int]:
    pattern = regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, sorted(rules.special, key=len, reverse=True)))) if rules.special else None
    pieces: list[str] = []
    bounds, extra = [0], []
    for text in texts:
        n = 0
        if special is not None and special.search(text):
            for part in special.split(text):
                pieces += pattern.findall(part)
            n = len(special.findall(text))
        else:
            pieces += pattern.findall(text)
        bounds.append(len(pieces))
        extra.append(n)
    sums = np.concatenate([[0], np.cumsum(piece_counts(pieces, rules))])
    return (np.diff(sums[bounds]) + np.array(extra, np.int64)).tolist()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row. ``vocabulary`` is a path on every machine."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = load_merges(vocabulary)
        for batch in batches:
            column = T.strings(batch.column(1))
            for block in T.blocks(column):
                n = text_counts(column.slice(block.first, len(block)).to_pylist(), rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(np.diff(block.bounds), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(count, schema)
