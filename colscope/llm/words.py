"""Words and word windows as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a Python worker remembers.
_WORDS = 200_000
#: Constants of the SplitMix64 generator.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def ascii_words(text: str, lower: bool = False) -> list[bytes]:
    """Runs of characters other than ASCII white space (what bytes.split takes as such); A-Z lower-cased on demand."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words, as signed 64-bit; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            out = _mixed(out * _MIX[0] + hashes[i:i + n])
    return out.view(np.int64)
