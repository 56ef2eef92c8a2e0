"""Big-endian fields of BINARY columns as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions.timing import col


def slice_bytes(data: Column | str, offset: Column | int, length: Column | int) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    length = F.lit(length) if isinstance(length, int) else length
    return F.substr(col(data), (offset + 1).cast("int"), length.cast("int"))


def be_uint(data: Column | str, offset: Column | int, length: int) -> Column:
    """Unsigned integer of ``length`` bytes at ``offset``; NULL when the bytes are not all there."""
    piece = slice_bytes(data, offset, length)
    return F.when(F.length(piece) == length, F.conv(F.hex(piece), 16, 10).try_cast("bigint"))


def be_int32(data: Column | str, offset: Column | int) -> Column:
    v = be_uint(data, offset, 4)
    return F.when(v >= 2147483648, v - 4294967296).otherwise(v)


def fourcc(data: Column | str, offset: Column | int = 0) -> Column:
    return F.decode(slice_bytes(data, offset, 4), "ISO-8859-1")


def has_bit(flags: Column | str, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(mask).cast("bigint")) != 0
