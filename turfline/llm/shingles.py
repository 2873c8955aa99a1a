"""Hashed word shingles of texts, as sorted NumPy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """word -> 64-bit hash, computed when first met; bounded memory. A task keeps one and drops it at its end."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = WIDTH, hashes: WordHashes | None = None) -> np.ndarray:
    """The distinct shingle hashes, ascending; a text with fewer words is one shingle, without words none."""
    hashes = WordHashes() if hashes is None else hashes
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            out = (out ^ ids[k : n - span + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
        out *= _END
        out ^= out >> np.uint64(32)
    return np.unique(out)
