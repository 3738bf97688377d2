"""Questions about hashes, sent in packed form.

A chunk of documents sends its distinct hashes, sorted and cut into groups by ranges of their value;
each group answers with a number for each, in the order in which they came.  Only groups that get
something get a message, so there are never more messages than hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .batches import byte_rows, raw_bytes


def group_of(values: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of each (sorted) hash: equal ranges of its upper 32 bits."""
    return ((values >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)


def packed(values: np.ndarray, n_groups: int, chunk: int, **more: np.ndarray) -> pa.Table:
    """Rows ``group, chunk, values, ...``: sorted values, and arrays that go with them, cut by group."""
    group = group_of(values, n_groups)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if group.size else group
    size = np.diff(np.append(first, group.size))
    cols = {"group": pa.array(group[first], pa.int32()), "chunk": pa.array(np.full(first.size, chunk), pa.int32())}
    for name, x in {"values": values, **more}.items():
        each = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
        cols[name] = byte_rows(np.ascontiguousarray(x).view("u1").ravel(), each * size)
    return pa.table(cols)


def received(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a group, and how many each message has."""
    data, size = raw_bytes(table.column(name))
    return data.view(kind), size // np.dtype(kind).itemsize


def reply(table: pa.Table, sizes: np.ndarray, numbers: np.ndarray) -> pa.Table:
    """A number for each value, for the chunks that sent them."""
    return pa.table({"chunk": table.column("chunk"), "group": table.column("group"), "numbers": byte_rows(numbers.view("u1"), numbers.itemsize * sizes)})


def replied(replies: pa.Table, kind: str, n: int) -> np.ndarray:
    """The numbers for the ``n`` values that a chunk has sent."""
    own = replies.take(pa.array(np.argsort(replies.column("group").to_numpy(), kind="stable")))
    numbers = raw_bytes(own.column("numbers"))[0].view(kind)
    if numbers.size != n:
        raise ValueError(f"{numbers.size} answers to {n} questions")
    return numbers
