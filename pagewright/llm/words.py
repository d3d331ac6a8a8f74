"""Words as the problems define them: maximal runs of letters and digits in the lower-cased text."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered. Emptied when it holds ``most`` words, so that it stays small on any corpus."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in one array, and the number of words of each text."""
    lists = [words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=int(sizes.sum()))
    return flat, sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(flat: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and position of all ``k``-word terms."""
    if len(flat) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix(flat[: len(flat) - k + 1])
    for j in range(1, k):
        h = mix(h + flat[j : len(flat) - k + 1 + j])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(h)) - starts[owner[: len(h)]]
    whole = pos + k <= sizes[owner[: len(h)]]
    return h[whole], owner[: len(h)][whole], pos[whole]
