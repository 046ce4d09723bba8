"""Polynomial hashes of byte ranges modulo 2**64, for whole arrays of ranges at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            x = np.full(max(n, 2 * len(_POWERS[0]), 1 << 16), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Sums:
    """Prefix sums of a byte string; hashes of its ranges depend on their content alone."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """Of every range of this width."""
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])
