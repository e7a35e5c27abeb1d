"""Hashed words and word shingles of whole texts, and their deal into fragments of the hash order."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .common import claim

#: Odd multipliers, and those of the finalizer.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A to Z lowered; white space is ASCII's."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes], limit: int = 150_000) -> np.ndarray:
    claim(_HASHES, _HASHES.clear)
    if len(_HASHES) > limit:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of `size` words, ascending; of fewer words, of all of them as one run."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = word_hashes(words)
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += h[i : i + n] * MULTIPLIERS[i % 5] * np.uint64(2 * (i // 5) + 1)
    return np.unique(mix(total))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of the hash order, cut into so many equal ranges."""
    return ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
