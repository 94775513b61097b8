"""Bitmaps that let tasks skip rows; a set bit may always be one too many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: what is broadcast is at least 512 KB and at most 32 MB.
LEAST, MOST = 1 << 22, 1 << 28


def bitmap_of(df: DataFrame, column: str, n: int, per_row: int = 1) -> np.ndarray:
    """A bitmap with the low bits of a long column set, sized for ``n`` rows with
    ``per_row`` bits each: about eight bits for each one set, within the bounds.
    Only the bitmap comes to the driver, however many rows there are."""
    size = LEAST
    while size < min(MOST, 8 * n * per_row):
        size *= 2
    at = df.select((F.col(column).bitwiseAND(F.lit(size - 1)) + 1).alias("b"))  # Spark counts bits from 1
    rows = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros(size // 8, np.uint8)
    for k, m in rows:
        part = np.frombuffer(bytes(m), np.uint8)
        out[(k - 1) * len(part) : k * len(part)] = part
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
