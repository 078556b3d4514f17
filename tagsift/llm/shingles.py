"""Word hashes and sets of word shingles of texts, in blocks of numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser with the constants of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text after the other, and the number of words of each text."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for own in words for w in own]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), counts


def lower_words(text: str | None) -> list[bytes]:
    """Words between white space (space and \\x09 to \\x0D) with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words (of fewer words: of all of them; of none: none)."""
    hashes, counts = word_hashes([lower_words(t) for t in texts])
    runs = [mix(hashes + _U(0x9E3779B97F4A7C15))]          # runs[k][i]: words i to i + k
    for k in range(1, size):
        runs.append(mix(runs[-1][:-1] ^ (hashes[k:] * _U(0xD6E8FEB86659FD93))) if len(runs[-1]) else runs[-1])
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(runs[-1][at:at + n - size + 1]) if n >= size else runs[n - 1][at:at + 1] if n else hashes[:0])
        at += n
    return out
