"""Vectorised access to Arrow string buffers.

All helpers work on one contiguous byte buffer plus row offsets, so that scans over many
short texts are a handful of NumPy passes instead of a Python loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Upper bound for the bytes that one vectorised pass works on; longer single texts form their own pass.
SLICE_BYTES = 4_000_000


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes, valid) of a string array; offsets start at 0 and null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    valid = np.asarray(arr.is_valid())
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), valid
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if arr.null_count:  # a null slot may still span bytes
        lens = np.where(valid, np.diff(off), 0)
        if lens.sum() != off[-1]:
            keep = np.repeat(valid, np.diff(off))
            data = data[keep]
        off = np.concatenate(([0], np.cumsum(lens)))
    return off, data, valid


def byte_slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` text bytes each; a longer single row stands alone."""
    off, _, _ = text_buffers(arr)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def spans_to_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """A string array of the spans [start, end) of `data`; `keep` masks bytes to leave out."""
    lens = end - start
    total = int(lens.sum())
    first = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(total) - np.repeat(first[:-1] - start, lens)
    out = data[at]
    if keep is not None:
        kept = keep[at]
        counts = np.concatenate(([0], np.cumsum(kept)))
        out, first = out[kept], counts[first]
    return pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(np.ascontiguousarray(out))]
    ).cast(pa.string())


def next_true(mask: np.ndarray) -> np.ndarray:
    """For each index (and one past the end) the first index >= it where mask holds, else len(mask)."""
    n = len(mask)
    at = np.where(mask, np.arange(n), n)
    out = np.full(n + 1, n, np.int64)
    out[:n] = np.minimum.accumulate(at[::-1])[::-1]
    return out


def last_true(mask: np.ndarray) -> np.ndarray:
    """For each index the last index <= it where mask holds, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)


_DDL = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL text; needs no session, so workers can use it."""
    return pa.schema([(name, _DDL[kind]) for name, kind in (x.split() for x in ddl.split(","))])
