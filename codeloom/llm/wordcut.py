"""Words of many texts at once: their places, keys and features in whole arrays, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from codeloom.llm.rolling import mixed

PAD = 8
#: Bytes of text cut at once; a longer text is cut alone.
GROUP = 4 << 20
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """The words of texts (A-Z lower-cased, runs of anything but ASCII white space), in order."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b" " * PAD + b"\n".join(texts).lower() + b" " * PAD
        self.bytes = np.frombuffer(self.data, np.uint8)
        gap = _GAP[self.bytes]
        at = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = at[::2], at[1::2]
        begins = np.cumsum([PAD, *(len(t) + 1 for t in texts)])
        #: Words of each text.
        self.counts = np.diff(np.searchsorted(self.starts, begins))

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self) -> np.ndarray:
        """64 bits of each word."""
        from xxhash import xxh64_intdigest

        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))  # the eight bytes from each place
        n = self.ends - self.starts
        first = eight[self.starts] & _MASK[np.minimum(n, 8)]
        last = np.where(n > 8, eight[self.ends - 8], np.uint64(0))
        out = mixed(first + mixed(last + mixed(n.astype(np.uint64))))  # a length added as it is would make up for other bytes
        long = np.flatnonzero(n > 16)
        for k, a, b in zip(long.tolist(), self.starts[long].tolist(), self.ends[long].tolist(), strict=True):
            out[k] = xxh64_intdigest(self.data[a:b])
        return out

    def last(self, k: int) -> np.ndarray:
        """The k-th byte from the end of each word, 0 if there is none."""
        at = self.ends - k
        return np.where(at >= self.starts, self.bytes[at], 0).astype(np.int64)

    def wide(self) -> np.ndarray:
        """Whether a word has bytes other than ASCII."""
        if not len(self):
            return np.zeros(0, bool)
        return np.maximum.reduceat(self.bytes, np.stack([self.starts, self.ends], axis=1).ravel())[::2] > 127

    def take(self, at: np.ndarray) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def groups(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, in groups of bounded size."""
    group, size = [], 0
    for t in texts:
        group.append((t or "").encode())
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Seen:
    """Sorted keys met so far."""

    def __init__(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number that each key was given, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def add(self, keys: np.ndarray) -> None:
        """New keys are given the next numbers, in this order."""
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.place = np.concatenate([self.place, np.arange(len(self.keys), len(every))])[order]
        self.keys = every[order]
