"""Vectorised text helpers: words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

A ``Block`` holds the bytes of some whole texts end to end. Every function works on all of them with numpy
passes and never mixes two texts. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside [0-9A-Za-z] and below \x80
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: A-Z to a-z, every other byte to itself
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
#: Of the hashes that tell strings apart: polynomials modulo this prime, at bases drawn from all numbers below it.
PRIME = np.uint64(2**61 - 1)
_PRIME_BASE = [int(x) for x in _random.integers(2**32, 2**61 - 2, 2, np.uint64)]
#: Bytes of a range that are hashed at once, so that sums stay within 62 bits.
LONG = 1 << 20
#: Bytes and ranges that are worked on at once, so that what is set aside for them stays small.
STEP = 1 << 17
_powers: dict[bool, np.ndarray] = {}
_prime_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers modulo 2**64 of an odd base or of its inverse."""
    known = _powers.get(inverse)
    if known is None or len(known) < n:
        base = _BASE if not inverse else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, 1 << 16), np.uint64(base))
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        _powers[inverse] = known if n <= 1 << 23 else _powers.get(inverse, known[: 1 << 16])
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Block:
    """Bytes of whole texts: text i is data[bounds[i]:bounds[i + 1]] and row i of ``rows``."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def parts(block: Block, limit: int = 1 << 18) -> Iterator[Block]:
    """The texts of a block in smaller ones, which share its bytes."""
    i = 0
    while i < len(block):
        j = max(i + 1, min(len(block), int(np.searchsorted(block.bounds, block.bounds[i] + limit, "right")) - 1))
        yield Block(block.data[block.bounds[i] : block.bounds[j]], block.bounds[i : j + 1] - block.bounds[i], i)
        i = j


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[Block]:
    """Whole texts in blocks of about ``limit`` bytes; a longer text is a block of its own."""
    column = strings(column)
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Block(whole[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


@dataclass
class Words:
    """Words of a block: bytes starts[k]:ends[k]; those of text i are bounds[i]:bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(block: Block, separators: np.ndarray = SPACE) -> Words:
    """Longest runs of bytes that are not separators."""
    inside = ~separators[block.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(block.bounds), np.int64))
    edges = block.bounds[(block.bounds > 0) & (block.bounds < n)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    finishes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, block.bounds))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums that give the hash of ranges of one size through ``gram_hashes``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of ``size`` bytes, in order of their starts: equal for equal bytes, good to choose by.

    A polynomial modulo 2 ** 64: some unlike ranges of a thousand bytes have equal ones, whatever its base. What must
    tell ranges apart takes ``span_hash``.
    """
    n = max(0, len(sums) - size)
    out = (sums[size:] - sums[:n]) * powers(len(sums), inverse=True)[:n]
    out += np.uint64(size * 0x9FB21C651E98DF25 & 2**64 - 1)
    return mix(out)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2 ** 64."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # below PRIME the difference wraps around


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a below 2 ** 62 and b below PRIME: by halves of 31 bits, as 2 ** 61 counts as 1."""
    low, half = np.uint64(2**31 - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64(2**30 - 1)) << half) + a0 * b0)


def prime_powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """The first n powers modulo PRIME of a base or of its inverse."""
    known = _prime_powers.get((which, inverse))
    if known is None or len(known) < n:
        base = _PRIME_BASE[which] if not inverse else pow(_PRIME_BASE[which], -1, int(PRIME))
        known = np.ones(1, np.uint64) if known is None else known
        while len(known) < max(n, 1 << 16):
            known = np.concatenate([known, product(known, np.uint64(pow(base, len(known), int(PRIME))))])
        if n <= 1 << 23:
            _prime_powers[which, inverse] = known
    return known[:n]


def sums(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial modulo PRIME over bytes, in two halves, that give the hash of any range."""
    powers, out = prime_powers(len(data), which), (np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64))
    for i in range(0, len(data), STEP):
        power, value = powers[i : i + STEP], data[i : i + STEP].astype(np.uint64) + np.uint64(1)
        for half, part in zip(out, (power & np.uint64(2**32 - 1), power >> np.uint64(32)), strict=True):
            own = half[i + 1 : i + 1 + len(value)]
            np.cumsum(value * part, out=own)
            own += half[i]
    return out


def span_hash(held: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges, given the sums: equal for equal bytes.

    Two unlike ranges of n bytes have equal ones for n of the 2 ** 61 bases at most. Two values of ``which`` are
    independent.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(starts) > STEP:
        return np.concatenate([span_hash(held, starts[i : i + STEP], ends[i : i + STEP], which) for i in range(0, len(starts), STEP)])
    pieces, out = -(-int((ends - starts).max()) // LONG), None
    for k in range(max(1, pieces)):
        a = np.minimum(starts + k * LONG, ends) if pieces > 1 else starts
        z = np.minimum(a + LONG, ends) if pieces > 1 else ends
        low, high = held[0][z] - held[0][a], held[1][z] - held[1][a]  # of LONG bytes: below 2 ** 60 and 2 ** 57
        own = low + ((high & np.uint64(2**29 - 1)) << np.uint64(32)) + (high >> np.uint64(29))
        out = own if out is None else reduced(out) + reduced(own)
    out = product(out, prime_powers(len(held[0]), which, inverse=True)[starts])
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def word_hashes(block: Block, found: Words, which: int = 0) -> np.ndarray:
    """span_hash of words, some texts at a time: so sums stay small."""
    out = np.empty(len(found), np.uint64)
    for part in parts(block):
        a, z, at = found.bounds[part.first], found.bounds[part.first + len(part)], block.bounds[part.first]
        out[a:z] = span_hash(sums(part.data, which), found.starts[a:z] - at, found.ends[a:z] - at, which)
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of hashes[k:k + n] for every k with so many after it: halves are mixed before they are joined."""
    out, size, at, rest = None, 1, 0, n
    part = hashes
    while rest:
        if rest & 1:
            end = len(hashes) - n + 1
            own = part[at : at + max(0, end)]
            out = own if out is None else joined(out, own)
            at += size
        rest >>= 1
        if rest:
            part = joined(part[:-size], part[size:]) if len(part) > size else part[:0]
            size *= 2
    return out if n else np.zeros(0, np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes, in order."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + mix(b ^ np.uint64(0x9E3779B97F4A7C15)))


def window_fits(bounds: np.ndarray, n: int) -> np.ndarray:
    """For every k: whether k:k + n lies in one text, given the bounds of texts."""
    total = int(bounds[-1])
    fits = np.ones(max(0, total - n + 1), bool)
    ends = bounds[1:]
    for j in range(1, n):
        at = ends - j
        fits[at[(at >= bounds[:-1]) & (at < len(fits))]] = False
    return fits


def covered(starts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """Positions below total that lie in any of the ranges."""
    if not len(starts):
        return np.zeros(total, bool)
    steps = np.bincount(starts, minlength=total + 1) - np.bincount(ends, minlength=total + 1)
    return np.cumsum(steps[:-1]) > 0


def run_count(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Maximal runs of true positions in each text."""
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = bounds[:-1]
    edges = edges[edges < len(mask)]
    begins[edges] = mask[edges]
    return per_text(begins, bounds)


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True positions in each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
