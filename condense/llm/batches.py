"""Parts of Arrow batches that bound what a task holds, and Arrow arrays of runs of bytes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(batch: pa.RecordBatch, text_at: int, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``most_bytes`` of text in column ``text_at``, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), at + most_rows)
        yield batch.slice(at, end - at)
        at = end


def byte_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of bytes as an Arrow array, without a copy."""
    ends = np.zeros(sizes.size + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), sizes.size, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def raw_bytes(rows: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow array of binaries without nulls, and each row's size."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    if not len(rows):
        return np.zeros(0, "u1"), np.zeros(0, np.int64)
    ends = np.frombuffer(rows.buffers()[1], np.int32, rows.offset + len(rows) + 1)[rows.offset:].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2], "u1") if rows.buffers()[2] is not None else np.zeros(0, "u1")
    return data[ends[0]:ends[-1]], np.diff(ends)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the given runs, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(start - (ends - size), size)


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on have pages of their own, which go back when they are freed
        return libc
    except (OSError, AttributeError):
        return None


def released(out: Iterator) -> Iterator:
    """The same values; at the end, memory that is free goes back to the system, so that a reused
    Python worker stays small while other stages run."""
    _libc()
    yield from out
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def trimmed(table: pa.Table) -> pa.Table:
    """The same for the result of a group."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)
    return table
