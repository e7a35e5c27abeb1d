"""Record types of fixed-width files, and the engine's options."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIB = 1 << 20


@dataclass(frozen=True)
class DType:
    """A fixed-width integer: its name, its little-endian layout, the Spark type that holds all its values."""

    name: str
    layout: str
    spark: str

    @property
    def width(self) -> int:
        return np.dtype(self.layout).itemsize

    @property
    def least(self) -> int:
        return int(np.iinfo(self.layout).min)

    @property
    def most(self) -> int:
        return int(np.iinfo(self.layout).max)


DTYPES = {
    d.name: d
    for d in (
        DType("u8", "<u1", "smallint"),
        DType("u16", "<u2", "int"),
        DType("u32", "<u4", "bigint"),
        DType("u64", "<u8", "decimal(20,0)"),
        DType("i8", "<i1", "tinyint"),
        DType("i16", "<i2", "smallint"),
        DType("i32", "<i4", "int"),
        DType("i64", "<i8", "bigint"),
    )
}

ALGORITHMS = ("heap", "std", "radix")


def dtype(name: str) -> DType:
    if name not in DTYPES:
        raise ValueError(f"unknown dtype {name!r}; known: {', '.join(DTYPES)}")
    return DTYPES[name]


@dataclass(frozen=True)
class Options:
    """What a run may choose. skip_sort: the input's files are sorted already. memory_bytes and io_ratio only enter plans and reports: Spark manages its own memory."""

    dtype: str = "u32"
    algorithm: str = "radix"
    threads: int | None = None
    memory_bytes: int = 100 * MIB
    io_ratio: float = 0.5
    flat_merge: bool = True
    fan_in: int = 0
    tree_height: int = 2
    skip_sort: bool = False

    def __post_init__(self):
        dtype(self.dtype)
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}; known: {', '.join(ALGORITHMS)}")
        if not 0 < self.io_ratio < 1:
            raise ValueError("io_ratio must lie between 0 and 1")
