"""Operators: sort, merge, verify, generate, radix statistics."""
