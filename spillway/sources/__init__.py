"""Sources and sinks: files of fixed-width integers."""

from .fixedbin import FixedBin, read_fixedbin, register, write_fixedbin

__all__ = ["FixedBin", "read_fixedbin", "register", "write_fixedbin"]
