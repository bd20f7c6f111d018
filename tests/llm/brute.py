"""Plain Python versions of the contracts, row by row and quadratic where that is simplest."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs):
    keys = {d: [lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)) for x in (t or "").split("\n")] for d, t in docs}
    held = {}
    for d, own in keys.items():
        for k in own:
            if len(k) >= 10:
                held.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[d]) if len(k) < 10 or min(held[k]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def first_holder(docs, n):
    first = {}
    for d, seq in docs:
        for i in range(len(seq) - n + 1):
            k = seq[i : i + n]
            if k not in first or first[k] > d:
                first[k] = d
    return first


def op2(docs, n=13):
    rows = [(d, tuple(WORD.findall(t or ""))) for d, t in docs]
    first, out = first_holder(rows, n), {}
    for d, w in rows:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[w[i : i + n]] < d:
                gone |= {*range(i, i + n)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op7(docs, n=50):
    rows = [(d, (t or "").encode()) for d, t in docs]
    first, out = first_holder(rows, n), {}
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def op3_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def op9(docs, items, n=10):
    out = {}
    tests = [(i, BENCH.findall(lower(t or ""))) for i, t in items]
    for d, t in docs:
        w = BENCH.findall(lower(t or ""))
        hit, found = set(), set()
        for item, x in tests:
            if not x:
                continue
            k = min(n, len(x))
            windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= {*range(i, i + k)}
                    found.add(item)
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def fingerprint(text, k=4):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op10(docs, k=4, distance=4):
    fps = {d: fingerprint(t, k) for d, t in docs}
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


#: The patterns of the contract.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def op6_base(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text) if len(m[0]) >= 32]
    spans = [x[2] for x in sorted(found)]
    return *(sum(x[1] == k for x in found) for k in range(3)), sha(",".join(spans)), spans


def one_of_each(docs, k=5, similarity=0.8):
    """Smallest ids of components by SimHash links and true Jaccard similarity."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    root = {d: c for d, (_, c) in op10(docs, k).items()}
    ids = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}
