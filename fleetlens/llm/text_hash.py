"""Word and shingle hashes of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stride(k: int) -> np.uint64:
    """k times GOLDEN, wrapped."""
    return np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, kept while the worker lives; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the bytes 20 and 09 to 0D (which is what ``bytes`` does)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence if it is shorter, none if empty."""
    n = len(words)
    size = min(size, n)
    if not n:
        return words
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * GOLDEN + words[k : n - size + 1 + k])
    return out
