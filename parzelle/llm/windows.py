"""Hashes of word windows and the minimisers that file them.

All functions take numpy arrays of a whole batch; windows that reach across two texts
are masked by the caller.
"""

from __future__ import annotations

import numpy as np

from parzelle.llm.words import Batch, word_hashes

#: Odd multiplier of the window polynomials, arithmetic modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)
LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of sums, whose low bits are weak."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Prefix sums of a batch's word hashes, from which any run of words is hashed."""

    def __init__(self, batch: Batch, seed: int):
        words = word_hashes(batch, seed)
        powers = np.full(len(words) + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        back = np.full(len(words) + 1, INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of ``length`` words from ``start``."""
        size = np.asarray(length, np.uint64)
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start]
                   + size * LENGTH_SALT)

    def every(self, length: int) -> np.ndarray:
        """Hashes of the runs of ``length`` words from every word."""
        n = max(len(self.sums) - length, 0)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n]
                   + np.full(n, length, np.uint64) * LENGTH_SALT)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def window_starts(batch: Batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every word at which a window of its own text starts, and the text's number."""
    windows = np.maximum(np.diff(batch.offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    before = np.cumsum(windows) - windows
    return np.arange(len(text)) - before[text] + batch.offsets[text], text
