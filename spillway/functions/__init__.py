"""Scalar functions as column expressions."""

from .formatting import (
    chunk_full_name,
    chunk_name,
    chunk_order,
    clear_flags,
    div_up,
    has_flags,
    num_format,
    parse_chunk_name,
    power_root,
    quote,
    round_down,
    round_up,
    set_flags,
    size_format,
    to_hex,
)

__all__ = ["chunk_full_name", "chunk_name", "chunk_order", "clear_flags", "div_up", "has_flags", "num_format", "parse_chunk_name", "power_root", "quote", "round_down", "round_up", "set_flags", "size_format", "to_hex"]
