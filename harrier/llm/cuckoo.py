"""Cuckoo filters in numpy: 16-bit fingerprints, 4 to a bucket, with insertion, deletion and lookup of many keys."""

from __future__ import annotations

import numpy as np

from harrier.llm.textops import mix

SLOTS = 4
KICKS = 500


class Full(Exception):
    """No place could be made for a key."""


def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and the two buckets of each key; either bucket follows from the other and the fingerprint."""
    h = mix(keys.astype(np.uint64))
    fp = ((h >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)
    one = (h & np.uint64(buckets - 1)).astype(np.int64)
    return fp, one, one ^ _step(fp, buckets)


def _step(fp: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(fp.astype(np.uint64) + np.uint64(0x5BD1E995)) & np.uint64(buckets - 1)).astype(np.int64)


def empty(keys: int) -> np.ndarray:
    """A table for so many keys at a load of at most three quarters."""
    buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.75))))
    return np.zeros((buckets, SLOTS), np.uint16)


def _put(table: np.ndarray, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Places what fits into free slots of the buckets; which keys found none."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], b[1:] != b[:-1]]), np.arange(len(b)), 0))
    turn = np.arange(len(b)) - first
    free = table[b] == 0
    slot = np.argsort(~free, axis=1, kind="stable")  # free slots first
    fits = turn < free.sum(1)
    table[b[fits], slot[fits, turn[fits]]] = fp[order[fits]]
    left = np.ones(len(b), bool)
    left[order[fits]] = False
    return left


def insert(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The table with the keys; raises Full if one finds no place (the exact table then builds a larger filter)."""
    table, buckets = table.copy(), len(table)
    if not len(keys):
        return table
    fp, one, two = _places(keys, buckets)
    left = _put(table, fp, one)
    fp, one, two = fp[left], one[left], two[left]
    if len(fp):
        left = _put(table, fp, two)
        fp, two = fp[left], two[left]
    for f, b in zip(fp.tolist(), two.tolist(), strict=True):
        for kick in range(KICKS):
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = f
                break
            slot = (kick * 7 + f) % SLOTS
            table[b, slot], f = f, int(table[b, slot])
            b = int(b ^ _step(np.array([f], np.uint16), buckets)[0])
        else:
            raise Full
    return table


def build(keys: np.ndarray) -> np.ndarray:
    size = len(keys)
    while True:
        try:
            return insert(empty(size), keys)
        except Full:
            size = size * 2 + SLOTS


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key held; rarely true for another."""
    fp, one, two = _places(keys, len(table))
    return (table[one] == fp[:, None]).any(1) | (table[two] == fp[:, None]).any(1)


def delete(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The table without one entry for each of the keys, all of which it must hold."""
    table = table.copy()
    fp, one, two = _places(keys, len(table))
    todo = np.arange(len(keys))
    while len(todo):
        in_one = table[one[todo]] == fp[todo, None]
        in_two = table[two[todo]] == fp[todo, None]
        here = in_one.any(1)
        if not (here | in_two.any(1)).all():
            raise KeyError("a key to delete is not held")
        slot = np.where(here, one[todo] * SLOTS + in_one.argmax(1), two[todo] * SLOTS + in_two.argmax(1))
        _, first = np.unique(slot, return_index=True)
        table.reshape(-1)[slot[first]] = 0
        todo = np.delete(todo, first)
    return table
