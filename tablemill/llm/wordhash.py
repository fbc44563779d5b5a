"""64-bit hashes of words and of word sequences, equal in every process."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers: the sequence hash is a polynomial over word hashes, finished by two
#: multiply-and-shift steps.
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Remembers the hashes of up to `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= STEP
        out += hashes[i : i + n]
    return mixed(out)


class Spans:
    """Hashes of any word range of one text in constant time, equal for equal words."""

    inverse = np.uint64(pow(int(STEP), -1, 2**64))
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Spans.powers) <= n:
            size = max(2 * n, 4096)
            Spans.powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, STEP))])
            Spans.inverses = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, Spans.inverse))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Spans.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Spans.inverses[start] + (end - start).astype(np.uint64))
