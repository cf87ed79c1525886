"""Words of a text as hashes, and hashes of their runs, without a Python object per word."""

from __future__ import annotations

import numpy as np

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a text that are looked at together.
PART = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """64-bit hashes of words: runs of bytes other than ``separators``, with A-Z as a-z.

    A word's hash is a polynomial over a table of random values, so those of all words come from one running sum.
    """

    def __init__(self, separators: bytes = SPACE):
        self.values = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
        self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        self.up, self.down = _powers(PART, _BASE), _powers(PART, pow(_BASE, -1, 2**64))

    def of(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        if len(data) <= PART:
            return self._of(data)
        out, start = [], 0
        while start < len(data):  # a part ends between words
            end = min(start + PART, len(data))
            while end < len(data) and self.inside[data[end]]:
                end += 1
            out.append(self._of(data[start:end]))
            start = end
        return np.concatenate(out)

    def _of(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):  # one very long word
            self.up, self.down = _powers(len(data), _BASE), _powers(len(data), pow(_BASE, -1, 2**64))
        edge = np.diff(self.inside[data].astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
        return h


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; of the whole where there are fewer (and at least one)."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = words[: len(words) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            h *= np.uint64(_BASE)
            h ^= h >> np.uint64(29)
            h += words[i : len(words) - k + 1 + i]
        h ^= h >> np.uint64(33)
        h *= _MIX
        h ^= h >> np.uint64(33)
        h += np.uint64((k - n) % 2**64)  # a short whole is no run of n words
    return h


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(hashes)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
