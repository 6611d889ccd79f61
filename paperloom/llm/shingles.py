"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingles of ``width`` words; words are runs of characters other than space and \\t to \\r, with A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle, a text without words none. Words and shingles are
    told apart by 64-bit hashes, so two different ones meet with a chance of 2**-64 a pair.
    """

    def __init__(self, width: int = 5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**63, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.power = np.ones(64, np.uint64)
        self.coef = rng.integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self._grow(4096)

    def _grow(self, n: int) -> None:
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]))

    def words(self, raw: np.ndarray) -> np.ndarray:
        white = self.white[raw]
        edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=1, append=1))
        if not len(edge):
            return np.empty(0, np.uint64)
        size = edge[1::2] - edge[0::2]
        if (most := int(size.max())) > len(self.power):
            self._grow(2 * most)
        at = np.cumsum(size) - size
        byte = raw[~white]
        place = np.arange(len(byte)) - np.repeat(at, size)
        return mix(np.add.reduceat(self.value[byte] * self.power[place], at))

    def shingles(self, text: str | None, step: int = 1 << 20) -> np.ndarray:
        """The sorted distinct shingles of ``text``; null has none. Long texts are hashed ``step`` bytes at a time."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        parts, lo = [], 0
        while lo < len(raw):
            hi = min(lo + step, len(raw))
            while hi < len(raw) and not self.white[raw[hi]]:
                hi += 1
            parts.append(self.words(raw[lo:hi]))
            lo = hi
        w = parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])
        if not len(w):
            return w
        n = len(w) - len(self.coef) + 1
        if n < 1:
            total = (w * self.coef[: len(w)]).sum(keepdims=True) + np.uint64(len(w))
            return mix(total)
        total = w[:n] * self.coef[0]
        for k in range(1, len(self.coef)):
            total += w[k : k + n] * self.coef[k]
        return np.unique(mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
