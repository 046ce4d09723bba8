"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search.

A shard is a list of byte strings; suffixes end with their string. Ranks of doubled prefixes refine the groups that are
still equal until every suffix has its place. Common prefixes with the neighbour in the array follow Kasai's rule (from one
position to the next the length falls by one at most), applied to whole runs: only positions whose preceding bytes differ
are compared byte for byte, eight at a time.
"""

from __future__ import annotations

import numpy as np

WORD = 8
_KEEP = np.array([0] + [(1 << 64) - (1 << (8 * (8 - r))) for r in range(1, 8)], np.uint64)


class Shard:
    """The suffix array of ``texts``: ``data``, ``ends`` (of the text at each byte), ``sa``."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(lengths)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        self.left = self.stops[self.owner] - np.arange(len(self.data))
        self.words = words_at(self.data)
        self.sa = self._sorted(len(texts))

    def _sorted(self, n_texts: int) -> np.ndarray:
        size, h = len(self.data), 7
        near = np.minimum(self.left, 7)
        key = (self.words & _KEEP[near]) | near.astype(np.uint64)
        sa = np.argsort(key)
        rank = np.empty(size, np.int64)
        active = np.arange(size)
        ordered = key[sa]
        while True:
            first = np.ones(len(active), bool)
            first[1:] = ordered[1:] != ordered[:-1]
            places = active[np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))]
            rank[sa[active]] = places
            single = first.copy()
            single[:-1] &= first[1:]
            active = active[~single]
            if not len(active):
                return sa
            at = sa[active]
            second = np.where(self.left[at] <= h, self.owner[at], n_texts + rank[np.minimum(at + h, size - 1)])
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            order = np.argsort(key)
            sa[active] = at[order]
            ordered = key[order]
            h *= 2

    def common_prefixes(self) -> np.ndarray:
        """At each place of the array, bytes shared with the place before."""
        size = len(self.data)
        if not size:
            return np.zeros(0, np.int64)
        before = np.full(size, -1, np.int64)
        before[self.sa[1:]] = self.sa[:-1]
        opens = np.ones(size, bool)
        opens[1:] = self.owner[1:] != self.owner[:-1]
        at = np.arange(size)
        compare = opens | (before < 0) | opens[before] | (self.data[at - 1] != self.data[before - 1])
        places = np.flatnonzero(compare)
        found = np.zeros(size, np.int64)
        some = places[before[places] >= 0]
        found[some] = self._shared(some, before[some])
        run = np.maximum.accumulate(np.where(compare, at, 0))
        return (found[run] - (at - run))[self.sa]

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.left[a], self.left[b])
        out, alive, done = most.copy(), np.arange(len(a)), 0
        while len(alive):
            x = self.words[a[alive] + done] ^ self.words[b[alive] + done]
            same = leading_bytes(x)
            ends = (same < WORD) | (done + WORD >= most[alive])
            stop = alive[ends]
            out[stop] = np.minimum(done + same[ends], most[stop])
            alive = alive[~ends]
            done += WORD
        return out

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose next ``length`` bytes also start elsewhere in the shard, and one position for each distinct string."""
        common = self.common_prefixes()
        again = common >= length
        hit = again.copy()
        hit[:-1] |= again[1:]
        whole = self.left[self.sa] >= length
        return self.sa[hit & whole], self.sa[whole & ~again]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(WORD):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the high end of each number."""
    out = np.zeros(len(x), np.int64)
    for k in range(WORD):
        out += (x >> np.uint64(56 - 8 * k)) == 0
    return out


class Merged:
    """Distinct strings of a fixed length from several shards in order; a new shard's strings are found by binary search."""

    def __init__(self, length: int) -> None:
        self.length, self.data, self.places = length, np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def _word(self, at: np.ndarray, k: int) -> np.ndarray:
        take = min(WORD, self.length - k)
        out = np.zeros(len(at), np.uint64)
        for j in range(take):
            out |= self.data[at + k + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of places."""
        out, alive = np.zeros(len(a), np.int8), np.arange(len(a))
        for k in range(0, self.length, WORD):
            x, y = self._word(a[alive], k), self._word(b[alive], k)
            differ = x != y
            out[alive[differ]] = np.where(x[differ] < y[differ], -1, 1)
            alive = alive[~differ]
            if not len(alive):
                break
        return out

    def add(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a shard with the places of its distinct strings in order. Returns which of them were there, and the places
        (in all data so far) that they met."""
        base = len(self.data)
        self.data = np.concatenate([self.data, data])
        new = places + base
        low, high = np.zeros(len(new), np.int64), np.full(len(new), len(self.places))
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            after = self._compare(new[open_], self.places[mid]) > 0
            low[open_[after]] = mid[after] + 1
            high[open_[~after]] = mid[~after]
        inside = np.flatnonzero(low < len(self.places))
        met = np.zeros(len(new), bool)
        met[inside] = self._compare(new[inside], self.places[low[inside]]) == 0
        old = self.places[low[met]]
        self.places = np.insert(self.places, low[~met], new[~met])
        return met, old
