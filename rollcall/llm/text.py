"""Words and shingles of whole texts, hashed in bulk inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 200_000


class WordHashes(dict):
    """Word to 64-bit hash.  It is emptied when full, so a worker's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; no words for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long columns, in their order."""
    out = columns[0] * MIX_1
    for column in columns[1:]:
        out = (out ^ (out >> np.uint64(29))) * STEP + column
    return mixed(out)


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words.

    Fewer words than that count as one shingle; no words give an empty set.
    """
    h = word_hashes(words)
    n = len(h)
    if n == 0:
        return h
    k = min(n, width)
    shingles = chained([h[i : n - k + 1 + i] for i in range(k)])
    if k < width:
        shingles = mixed(shingles + np.uint64(k))
    return np.unique(shingles)
