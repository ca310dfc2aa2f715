"""64-bit hashes of words, for many words at once.

Words of up to 16 bytes are taken whole, as two numbers and their length, so no two of them meet
before the final mixing, whatever their structure.  Longer words go through BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

HALF = 8
_HIGH = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(flat: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of each run ``first:after`` of the bytes ``flat``."""
    size = after - first
    padded = np.concatenate([flat, np.zeros(2 * HALF, np.uint8)])
    halves = []
    for start in (0, HALF):
        half = np.zeros(len(first), np.uint64)
        for k in range(start, start + HALF):
            there = np.flatnonzero(size > k)
            half[there] |= padded[first[there] + k].astype(np.uint64) << np.uint64(8 * (k - start))
        halves.append(half)
    out = mix(mix(mix(halves[0]) + mix(halves[1] ^ _HIGH) * _HIGH) + size.astype(np.uint64))
    long = np.flatnonzero(size > 2 * HALF)
    if len(long):
        raw = flat.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first[long].tolist(), after[long].tolist(), strict=True))
        out[long] = np.frombuffer(digests, "<u8")
    return out
