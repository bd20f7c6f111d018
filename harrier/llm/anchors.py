"""Content-chosen positions, by which equal stretches of text are dealt to the same place.

Among the starts of the ``size``-byte grams of every stretch of ``length`` bytes, the first one of the least hash is
its anchor: chosen by nothing but the stretch's own content. Stretches that start one after another and have the same
anchor are a run; an excerpt of the text holds all stretches of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from harrier.llm import textops as T


def slide(least: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """least over every n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


@dataclass
class Runs:
    """Runs of stretches: those that start at start:end, the text they lie in, and the hash of their anchor's gram."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    key: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def anchored(sums: np.ndarray, bounds: np.ndarray, length: int, size: int) -> Runs:
    """All stretches of ``length`` bytes within a text, as runs. sums: see textops.prefix; bounds: of the texts."""
    total, none = len(sums) - 1, np.zeros(0, np.int64)
    if total < length:
        return Runs(none, none, none, none.astype(np.uint64))
    keys = T.gram_hashes(sums, size)
    # positions below 2 ** 32 break ties among equal high bits: the first one wins
    ranked = (keys & ~np.uint64(2**32 - 1)) | np.arange(len(keys), dtype=np.uint64)
    anchor = (slide(np.minimum, ranked, length - size + 1) & np.uint64(2**32 - 1)).astype(np.int64)
    fits = np.flatnonzero(T.window_fits(bounds, length))
    if not len(fits):
        return Runs(none, none, none, none.astype(np.uint64))
    anchor = anchor[fits]
    at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1)]))
    start, end = fits[at], fits[np.concatenate([at[1:], [len(fits)]]) - 1] + 1
    return Runs(start, end, np.searchsorted(bounds, start, "right") - 1, keys[anchor[at]])
