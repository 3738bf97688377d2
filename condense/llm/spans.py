"""Runs of bytes of a class within rows of an Arrow buffer, their hashes, and which of them are equal.

Everything works on whole buffers with NumPy: byte classes by a table of 256, runs by comparing
neighbours, hashes by prefix sums.  Equality by hash is verified on the bytes themselves.
"""

from __future__ import annotations

import numpy as np

from .batches import runs
from .wordhash import _BYTE_ODD, _byte_values, mix, powers

_U = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the 256 bytes: whether each lies in one of the (inclusive) ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


def spans(data: np.ndarray, sizes: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, size and row of each longest run of ``member`` bytes that lies within a row."""
    inside = member[data]
    begins_row = np.zeros(data.size + 1, bool)
    begins_row[np.cumsum(sizes) - sizes] = True
    cut = begins_row[1:data.size]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut
    end[:-1] &= ~inside[1:] | cut
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1 - first, np.searchsorted(np.cumsum(sizes), first, "right")


def counts(data: np.ndarray, sizes: np.ndarray, member: np.ndarray) -> np.ndarray:
    """How many ``member`` bytes each row has, by prefix sums."""
    total = np.zeros(data.size + 1, np.int64)
    np.cumsum(member[data], out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def span_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = powers(_BYTE_ODD, max(1, data.size))
    total = np.zeros(data.size + 1, _U)
    np.cumsum(_byte_values()[data] * up[:data.size], out=total[1:])
    return mix((total[first + size] - total[first]) * down[first] ^ size.astype(_U) << _U(48))


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether all runs of ``size`` bytes at ``a`` equal those at ``b``."""
    return bool(np.array_equal(data[runs(a, size)], data[runs(b, size)]))


def classes(data: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray | None = None, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the spans in which equal spans (of equal ``key``) stand together, and which of them,
    in that order, is another than the one before.

    Spans are sorted by hash, and neighbours of one hash are compared byte by byte; where any two
    differ, all spans are numbered by their bytes instead.
    """
    h = span_hashes(data, first, size) if h is None else h
    order = np.argsort(h, kind="stable") if key is None else np.lexsort((h, key))
    new = np.ones(order.size, bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    if key is not None:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(~new)
    a, b = order[at - 1], order[at]
    if not (np.array_equal(size[a], size[b]) and equal_bytes(data, first[a], first[b], size[a])):
        seen: dict[bytes, int] = {}
        whole = data.tobytes()
        exact = [seen.setdefault(whole[i:i + n], len(seen)) for i, n in zip(first.tolist(), size.tolist(), strict=True)]
        return classes(data, first, size, key, np.array(exact, _U))
    return order, new


def segments(data: np.ndarray, member: np.ndarray, most_bytes: int):
    """A long row in consecutive pieces of about ``most_bytes``, none of which cuts a run of ``member``."""
    at = 0
    while at < data.size:
        end = at + most_bytes
        while end < data.size:
            gap = np.flatnonzero(~member[data[end:end + most_bytes]])
            if gap.size:
                end += int(gap[0])
                break
            end += most_bytes
        yield data[at:end]
        at = end
