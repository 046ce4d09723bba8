"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(t or "")


def fingerprint(t, n=3):
    import xxhash

    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contained(doc, item, n=5):
    def shingles(t):
        w = words(lower(t))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    own = shingles(item)
    return (len(own), len(own & shingles(doc))) if own else (0, 0)


def shingle_set(t, n=5):
    w = words(lower(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def quality(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def grams(t):
    """N-grams of one to three letters or single spaces as numbers of 21 bits a code point."""
    x = []
    for c in f" {t or ''} ":
        v = ord(c.lower()[0]) if c.isalpha() else 32
        if not (v == 32 and x and x[-1] == 32):
            x.append(v)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            if x[i : i + n] != [32]:
                out[sum(v << 21 * (n - 1 - k) for k, v in enumerate(x[i : i + n]))] += 1
    return out if len(x) > 1 else Counter()
