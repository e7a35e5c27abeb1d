"""CRC-64 of ordered bytes: blocks are folded side by side in numpy, and joined as matrices over GF(2)."""

from __future__ import annotations

import numpy as np

#: The generator with its bits reversed; start 0, nothing added at the end.
REFLECTED = 0x95AC9329AC4BC9B5

BLOCK = 4096


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        t = np.where(t & np.uint64(1), (t >> np.uint64(1)) ^ np.uint64(REFLECTED), t >> np.uint64(1))
    return t


TABLE = _table()


def _columns_of_zero_byte() -> list[int]:
    """What a zero byte makes of each single bit."""
    return [int(TABLE[(1 << i) & 255]) ^ ((1 << i) >> 8) for i in range(64)]


def _apply(columns: list[int], value: int) -> int:
    out, i = 0, 0
    while value:
        if value & 1:
            out ^= columns[i]
        value >>= 1
        i += 1
    return out


def _product(a: list[int], b: list[int]) -> list[int]:
    return [_apply(a, x) for x in b]


_POWERS = [_columns_of_zero_byte()]


def shift(crc: int, n: int) -> int:
    """The checksum of the same bytes with n zero bytes after them."""
    k = 0
    while n:
        while len(_POWERS) <= k:
            _POWERS.append(_product(_POWERS[-1], _POWERS[-1]))
        if n & 1:
            crc = _apply(_POWERS[k], crc)
        n >>= 1
        k += 1
    return crc


def combine(first: int, second: int, second_bytes: int) -> int:
    """The checksum of two runs of bytes, one behind the other."""
    return shift(first, second_bytes) ^ second


def crc64(data: bytes, crc: int = 0) -> int:
    raw = np.frombuffer(data, np.uint8)
    blocks = len(raw) // BLOCK
    if blocks > 1:
        lanes = raw[: blocks * BLOCK].reshape(blocks, BLOCK).T.copy()
        state = np.zeros(blocks, np.uint64)
        for column in lanes:
            state = TABLE[(state ^ column) & np.uint64(255)] ^ (state >> np.uint64(8))
        while len(state) > 1:
            crc = combine(crc, int(state[0]), BLOCK)
            state = state[1:]
        crc = combine(crc, int(state[0]), BLOCK)
        raw = raw[blocks * BLOCK :]
    for byte in raw.tolist():
        crc = int(TABLE[(crc ^ byte) & 255]) ^ (crc >> 8)
    return crc


def hex64(crc: int) -> str:
    return f"{crc:016x}"


class Hasher:
    """A checksum that grows by integers, texts, lists of them, or bytes."""

    def __init__(self, layout: str = "<u4"):
        self.layout, self.crc, self.size = layout, 0, 0

    def put(self, value) -> Hasher:
        if isinstance(value, str):
            value = value.encode()
        elif isinstance(value, int):
            value = np.array([value], self.layout).tobytes()
        elif not isinstance(value, bytes | bytearray):
            value = np.asarray(value, self.layout).tobytes()
        self.crc, self.size = crc64(bytes(value), self.crc), self.size + len(value)
        return self

    def merge(self, later: Hasher) -> Hasher:
        self.crc, self.size = combine(self.crc, later.crc, later.size), self.size + later.size
        return self

    def digest(self) -> bytes:
        return self.crc.to_bytes(8, "little")

    def hexdigest(self) -> str:
        return hex64(self.crc)
