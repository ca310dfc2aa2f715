"""Word shingles of texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import random

import numpy as np

from parallaxis.llm.hashing import hashed_words, mix

_random = random.Random(20260702)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [np.uint64(_random.getrandbits(64) | 1) for _ in range(64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # what ends a word, fixed by the contract


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words up to each text's end."""
    raw = [(t or "").encode() for t in texts]
    flat = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[flat]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    after = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    return hashed_words(flat, first, after), np.searchsorted(first, ends)


def shingle_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of all texts in a row, and where each text's begin.

    A text of fewer words has one shingle, all of its words; one without words has none.
    The second array has one more entry than there are texts.  Repeats are kept.
    """
    word, upto = word_hashes(texts)
    n_words = np.diff(np.concatenate([[0], upto]))
    begin = upto - n_words
    # shingles of k words, wherever k words are left in the same text
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(begin, counts)
    size = np.repeat(np.minimum(n_words, k), counts)
    h = size.astype(np.uint64)
    for j in range(k):
        there = size > j
        h = h + np.where(there, word[np.minimum(at + j, max(0, len(word) - 1))] * _STEP[j], np.uint64(0)) if len(word) else h
    return mix(h), starts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    h, starts = shingle_hashes(texts, k)
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
