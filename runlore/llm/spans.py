"""Hashes of words in a byte buffer, all at once: small vectorised helpers for tasks that look at every word."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Longest table of powers that a worker keeps.
KEPT = 4_000_000
#: ASCII white space: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer buffer comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
            if n > KEPT:  # for one very long text
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span's bytes: a polynomial in an odd base from prefix sums, then mixed."""
    up, down = _cache.to(len(buffer) + 1)
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.concatenate([[False], ~SPACE[buffer], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]
