"""Elias-Fano sequences: a non-decreasing list of integers in about 2 + log2(u / n) bits each.

Each value's low bits lie packed, its high bits in unary as the distance to the value before. For select, the place of
every SAMPLE-th one of the unary part lies packed as well, in as few bits as hold a place: about an
eighth of a bit a value. Select reads a sample and the bytes behind it up to the wanted one; there
is no other table, in the file or in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: One place of every so many ones is kept, for select.
SAMPLE = 256

#: Values that are encoded, or decoded, at a time; a multiple of 8, so that each block's bits end with a byte.
BLOCK = 1 << 14


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of values, one behind the other."""
    if not bits:
        return np.zeros(0, np.uint8)
    shifts = np.arange(bits, dtype=np.uint64)
    parts = [np.packbits((values[i : i + BLOCK, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, len(values), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def unpack(packed: np.ndarray, first: int, last: int, bits: int) -> np.ndarray:
    """Values first .. last - 1 of what pack() made."""
    if not bits:
        return np.zeros(last - first, np.uint64)
    a = first * bits
    held = np.unpackbits(packed[a >> 3 : (last * bits + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + (last - first) * bits]
    return (held.reshape(-1, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class EliasFano:
    """values must not decrease and not be negative; they are below 2^64."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples
        self.place_bits = (8 * len(high)).bit_length()

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values)
        if len(v) and (int(v.min()) < 0 or (v[1:] < v[:-1]).any()):
            raise ValueError("values must not decrease and not be negative")
        v = v.astype(np.uint64, copy=False)
        n, last = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        high = np.zeros(((last >> bits) + n + 7 >> 3) if n else 0, np.uint8)
        places = []
        for i in range(0, n, BLOCK):
            ones = (v[i : i + BLOCK] >> np.uint64(bits)).astype(np.int64) + np.arange(i, min(n, i + BLOCK))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            places.append(ones[::SAMPLE])
        samples = np.concatenate(places).astype(np.uint64) if places else np.zeros(0, np.uint64)
        return cls(n, bits, pack(v, bits), high, pack(samples, (8 * len(high)).bit_length()))

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Places of the ones first .. last - 1, by the sample before them."""
        j = first // SAMPLE
        at = int(unpack(self.samples, j, j + 1, self.place_bits)[0])
        skip, need, byte, step, found = first - j * SAMPLE, last - j * SAMPLE, at >> 3, 128, []
        held = 0
        while held < need:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + step], bitorder="little")) + 8 * byte
            ones = ones[ones >= at]
            found.append(ones[max(0, skip - held) : need - held])
            held, byte, step = held + len(ones), byte + step, min(2 * step, 1 << 16)
        return np.concatenate(found)

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values first .. last - 1 (all: without them) as uint64."""
        last = self.n if last is None else last
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.uint64)
        high = (self._ones(first, last) - np.arange(first, last)).astype(np.uint64)
        return (high << np.uint64(self.bits)) + unpack(self.low, first, last, self.bits)

    def blocks(self, size: int = BLOCK) -> Iterator[np.ndarray]:
        """All values, `size` at a time."""
        for i in range(0, self.n, size):
            yield self.values(i, min(self.n, i + size))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.values(i, i + 1)[0])

    def find(self, x: int) -> int:
        """How many values are at most x."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(mid) <= x else (low, mid)
        return low

    def nbytes(self) -> int:
        """Bytes of all that is held."""
        return len(self.low) + len(self.high) + len(self.samples)
