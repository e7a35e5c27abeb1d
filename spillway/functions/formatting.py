"""Sizes, counts, hex, names of chunks, alignment and flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units and names.
KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
CHUNK_DIR, CHUNK_SEP = "chunks", "_"


def _div(a: Column, b: int | Column) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def size_format(size: Column) -> Column:
    """Whole Bytes, KiB, MiB or GiB, cut off."""
    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit("Bytes")))
        .when(size < MIB, F.concat(_div(size, KIB).cast("string"), F.lit("KiB")))
        .when(size < GIB, F.concat(_div(size, MIB).cast("string"), F.lit("MiB")))
        .otherwise(F.concat(_div(size, GIB).cast("string"), F.lit("GiB")))
    )


def num_format(n: Column) -> Column:
    """The number, or whole thousands with K, or whole millions with M, cut off."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(_div(n, 1000).cast("string"), F.lit("K"))).otherwise(F.concat(_div(n, 1_000_000).cast("string"), F.lit("M")))


def to_hex(n: Column, upper: bool = False) -> Column:
    return F.hex(n) if upper else F.lower(F.hex(n))


def chunk_name(lvl: Column, id: Column) -> Column:
    return F.concat_ws(CHUNK_SEP, to_hex(lvl), to_hex(id))


def chunk_full_name(lvl: Column, id: Column) -> Column:
    return F.concat(F.lit(CHUNK_DIR + "/"), chunk_name(lvl, id))


def parse_chunk_name(name: Column) -> Column:
    """struct(lvl, id) of a chunk's name, null where it is none."""
    half = lambda i: F.conv(F.split_part(name, F.lit(CHUNK_SEP), F.lit(i)), 16, 10).cast("long")
    return F.when(name.rlike(r"^[0-9a-fA-F]{1,8}_[0-9a-fA-F]{1,8}$"), F.struct(half(1).alias("lvl"), half(2).alias("id")))


def chunk_order(lvl: Column, id: Column) -> list[Column]:
    """Chunks follow each other by number, then by level."""
    return [id.asc(), lvl.asc()]


def div_up(a: Column, b: int | Column) -> Column:
    return _div(a + b - 1, b)


def round_up(i: Column, m: int | Column) -> Column:
    return div_up(i, m) * m


def round_down(i: Column, m: int | Column) -> Column:
    return _div(i, m) * m


def set_flags(value: Column, flags: int | Column) -> Column:
    return value.bitwiseOR(flags)


def has_flags(value: Column, flags: int | Column) -> Column:
    return value.bitwiseAND(flags) == flags


def clear_flags(value: Column, flags: int) -> Column:
    return value.bitwiseAND(~flags)


def power_root(a: Column, c: Column) -> Column:
    """The c-th root of a, at least the square root."""
    return F.pow(a, 1.0 / F.greatest(c, F.lit(2)))


def quote(s: Column) -> Column:
    return F.concat(F.lit("'"), s, F.lit("'"))
