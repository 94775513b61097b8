"""Encoding Arrow string columns unit by unit, each distinct unit once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start+length]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return flat[at]


def portions(batch: pa.RecordBatch, column: str, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a string column, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def encode_rows(lists: pa.ListArray, search: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each row) for rows of units; ``search`` gets each
    distinct unit once and gives the ids of all, and of each their number."""
    rows = np.asarray(lists.offsets, dtype=np.int64)
    codes = lists.flatten().dictionary_encode()
    flat, size = search(codes.dictionary)
    starts = np.cumsum(size) - size
    c = np.asarray(codes.indices)
    lengths = size[c] if len(c) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    rows = rows - (rows[0] if len(rows) else 0)
    return take(flat, starts[c] if len(c) else c, lengths), ends[rows[1:]] - ends[rows[:-1]]
