"""Suffix arrays of byte strings in numpy: refinement in the manner of Larsson and Sadakane, common prefixes as Kasai's.

``suffix_order`` sorts by the first 8 bytes, then doubles: only groups of suffixes that are still equal are sorted
again, by the rank of the suffix that starts as far behind as the group is known to agree. ``common_prefixes``
follows Kasai: the prefix shared with the suffix sorted before shrinks by at most one from one position to the
next, so bytes are compared only where it can grow, and a running maximum carries it on.
"""

from __future__ import annotations

import numpy as np


def _heads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number, first byte highest; past the end come zeros."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | wide[j : j + len(data)]
    return out


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, heads)."""
    n = len(data)
    heads = _heads(data)
    if not n:
        return np.zeros(0, np.int64), heads
    order = np.argsort(heads, kind="stable")
    short = np.minimum(n - np.arange(n), 8)  # tells the last suffixes from those with zeros behind
    tail = heads[max(0, n - 8) :]
    clash = np.isin(heads[order], tail)
    if clash.any():
        at = np.flatnonzero(clash)
        rows = order[at]
        order[at] = rows[np.lexsort((short[rows], heads[rows]))]
    new = np.ones(n, bool)
    new[1:] = (heads[order][1:] != heads[order][:-1]) | (short[order][1:] != short[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known = 8
    while known < n:
        begins = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([begins, [n]]))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order that are not settled
        if not len(open_):
            break
        rows = order[open_]
        key = rank[rows] * (n + 2) + rank[np.minimum(rows + known, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_] = rows[by]
        key = key[by]
        new[open_] |= np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[open_]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[open_]
        known *= 2
    return order, heads


def common_prefixes(data: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each place in the order: bytes shared with the suffix before it.

    Positions are compared only where the byte before them differs from that before their neighbour; elsewhere the
    prefix is one shorter than at the position before.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here = np.arange(n)
    grows = (before <= 0) | (here == 0)
    inner = np.flatnonzero(~grows)
    grows[inner] = data[inner - 1] != data[before[inner] - 1]
    shared = np.full(n, -n, np.int64)
    shared[before < 0] = 0
    todo = np.flatnonzero(grows & (before >= 0))
    length, alive, k = np.zeros(len(todo), np.int64), np.arange(len(todo)), 0
    while len(alive):
        a, b = todo[alive] + k, before[todo[alive]] + k
        fine = (a < n) & (b < n)
        alive, a, b = alive[fine], a[fine], b[fine]
        differ = heads[a] ^ heads[b]
        equal = differ == 0
        whole = np.full(len(differ), 8)
        odd = differ[~equal]
        lead = np.zeros(len(odd), np.int64)
        for step in (32, 16, 8):  # equal bytes in front
            high = odd >> np.uint64(64 - step) == 0
            lead[high] += step // 8
            odd = np.where(high, odd << np.uint64(step), odd)
        whole[~equal] = lead
        length[alive] += whole
        alive = alive[equal]
        k += 8
    shared[todo] = np.minimum(length, n - np.maximum(todo, before[todo]))
    return np.maximum(np.maximum.accumulate(shared + here) - here, 0)[order]


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``length``-byte strings at the valid starts: (starts in suffix order, number of each one's string, heads)."""
    order, heads = suffix_order(data)
    new = common_prefixes(data, order, heads) < length
    good = valid[order]
    group = np.cumsum(new)[good]
    if len(group):
        _, group = np.unique(group, return_inverse=True)
    return order[good], group, heads


def spelled(heads: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings as rows of big-endian numbers, eight bytes each, so that rows compare as the strings do."""
    at = [*range(0, length - 7, 8)]
    columns = [heads[starts + k] for k in at]
    if 8 * len(at) < length:
        rest = length - 8 * len(at)
        columns.append(heads[np.minimum(starts + 8 * len(at), len(heads) - 1)] >> np.uint64(8 * (8 - rest)))
    return np.stack(columns, 1) if len(starts) else np.zeros((0, len(columns)), np.uint64)


def before(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row of a comes before that of b, and whether both are equal."""
    less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in range(a.shape[1]):
        less |= same & (a[:, k] < b[:, k])
        same &= a[:, k] == b[:, k]
    return less, same


def find(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the place of each wanted row among the ascending rows, and whether it is there."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        less, _ = before(rows[middle], wanted[open_])
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    there = np.zeros(len(wanted), bool)
    inside = np.flatnonzero(low < len(rows))
    there[inside] = before(rows[low[inside]], wanted[inside])[1]
    return low, there


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two shards' distinct strings, in suffix order with the least id of each, as those of one."""
    (rows, ids), (more, other) = one, two
    at, there = find(rows, more)
    ids = ids.copy()
    ids[at[there]] = np.minimum(ids[at[there]], other[there])
    return np.insert(rows, at[~there], more[~there], axis=0), np.insert(ids, at[~there], other[~there])
