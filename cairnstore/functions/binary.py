"""Numbers and pieces in binary columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def big_endian(value: Column, bytes_: int) -> Column:
    """The value's hex digits, high byte first, at this width."""
    return F.lpad(F.hex(value.cast("long")), bytes_ * 2, "0")


def number(data: Column, first: Column | int, bytes_: int) -> Column:
    """The big-endian number in ``bytes_`` bytes from the 1-based place ``first`` on."""
    start = first if isinstance(first, Column) else F.lit(first)
    return F.conv(F.hex(F.substring(data, start, F.lit(bytes_))), 16, 10).cast("long")


def joined_bytes(parts: Column, field: str) -> Column:
    """The binary ``field`` of an array of structs, put together in its order; linear in the bytes."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p[field])), ""))
