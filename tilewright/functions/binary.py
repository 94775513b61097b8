"""Big-endian numbers and signatures inside binary columns (offsets from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(data: Column, offset: Column | int, n: int) -> Column:
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(data, offset + 1, F.lit(n))


def unsigned(data: Column, offset: Column | int, n: int) -> Column:
    """An unsigned number of up to 7 bytes; null past the end of the data."""
    part = _at(data, offset, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def signed(data: Column, offset: Column | int, n: int) -> Column:
    v = unsigned(data, offset, n)
    return F.when(v >= 1 << (8 * n - 1), v - (1 << 8 * n)).otherwise(v)


def four_cc(data: Column, offset: Column | int = 0) -> Column:
    return F.decode(_at(data, offset, 4), "US-ASCII")


def four_cc_of(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "US-ASCII")


def four_cc_number(text: Column) -> Column:
    return F.conv(F.hex(F.encode(text, "US-ASCII")), 16, 10).cast("long")


def starts_with(data: Column, signature: bytes) -> Column:
    return _at(data, 0, len(signature)) == F.lit(bytearray(signature))


def sha256_upper(data: Column) -> Column:
    return F.upper(F.sha2(data, 256))
