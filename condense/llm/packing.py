"""Harmonic packing of documents into fixed-capacity token sequences.

Whole sequences are cut off a document first.  What remains, at most one piece a document, belongs
to class k if its length is in (capacity / (k + 1), capacity / k], and each bin of class k takes
exactly k such pieces; the last class, of all shorter lengths, fills its bins one after another.
A bin that has its pieces and still has room takes it from the next document, which is the only
other cut.  Every partition fills its own bins, so nothing is shuffled.  The few bins that are open
when a partition ends are emptied into full sequences and one tail, cut at powers of two.
Sequences at a power of two need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_rows, parts, released, runs
from .bpe import BLOCK_BYTES, BLOCK_TEXTS, encoder, splits_at_white_space, utf8

CAPACITY = 2048
END = 1
#: Classes of lengths; the last holds all that are shorter than ``capacity / CLASSES``.
CLASSES = 16
_SCHEMA = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def tail(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the sequences that hold ``n`` ids without padding: full ones, then powers of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Open bins of one partition: an id, how much is in it and how many pieces."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes = first_id, capacity, min(classes, capacity)
        self.bins: dict[int, list[int]] = {}
        self.gap: list[int] | None = None  # the bin that takes its room from the next document

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def open(self) -> list[int]:
        """Bins with room."""
        return [b[0] for b in self.bins.values()] + ([self.gap[0]] if self.gap else [])

    def add(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``start, length, bin, offset`` of the pieces of a document with ``n`` ids."""
        at = 0
        while n - at >= self.capacity:
            yield at, self.capacity, self._new(), 0
            at += self.capacity
        if self.gap and at < n:
            own, filled, _ = self.gap
            size = min(n - at, self.capacity - filled)
            yield at, size, own, filled
            self.gap[1] += size
            at += size
            if self.gap[1] == self.capacity:
                self.gap = None
        if at < n:
            size = n - at
            k = min(self.capacity // size, self.classes)
            b = self.bins.setdefault(k, None) or [self._new(), 0, 0]
            self.bins[k] = b
            own, filled, _ = b
            size = min(size, self.capacity - filled)
            yield at, size, own, filled
            b[1] += size
            b[2] += 1
            if b[2] == k if k < self.classes else b[1] > self.capacity - self.capacity // self.classes:
                del self.bins[k]
                if b[1] < self.capacity:
                    self.gap = b

    def rest(self, lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """``piece, start, length, bin, offset``: pieces of the open bins, cut into sequences without
        padding."""
        sizes = iter(tail(sum(lengths), self.capacity))
        own, room, offset = -1, 0, 0
        for i, n in enumerate(lengths):
            at = 0
            while at < n:
                if not room:
                    own, room, offset = self._new(), next(sizes), 0
                size = min(room, n - at)
                yield i, at, size, own, offset
                at, room, offset = at + size, room - size, offset + size


def harmonic_pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """Tokenize every whole text, append ``end_id`` and pack all ids.

    Returns a row per piece: ``id_col, start, length, ids`` (little-endian 32-bit), ``doc_tokens,
    sequence_id, offset``.  A null or empty text is the end id alone; repeated rows are packed
    each, and a null id stays null; an empty table gives no rows; other columns, whatever their
    names, are ignored.  ``capacity`` must be a power of two.  A partition holds the pieces of at most
    ``CLASSES`` open bins, so its memory is bounded.  Sequence ids hold the partition in their
    upper bits and do not depend on other partitions, so a task that runs again after a loss gives
    the same rows.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    if not splits_at_white_space(path):
        raise ValueError("tokens of this tokenizer can span white space")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows(key: pa.Array, start, length, ids: pa.Array, total, own, offset) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.int64()) for x in (start, length)), ids, *(pa.array(x, pa.int64()) for x in (total, own, offset))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        held: list[pa.RecordBatch] = []  # pieces of open bins
        for batch in (p for b in batches for p in parts(b, 1, BLOCK_BYTES, BLOCK_TEXTS)):
            ids, counts = enc.encode(batch.column(1))
            counts = counts + 1
            full = np.full(int(counts.sum()), end_id, "<u4")
            full[runs(np.cumsum(counts) - counts, counts - 1)] = ids
            made = [(i, *p) for i, n in enumerate(counts.tolist()) for p in packer.add(n)]
            doc, start, length, own, offset = np.asarray(made, np.int64).reshape(-1, 5).T
            new = rows(batch.column(0).take(pa.array(doc)), start, length, byte_rows(full.view("u1"), 4 * length), counts[doc], own, offset)
            both = pa.Table.from_batches([*held, new]).combine_chunks()
            waiting = np.isin(both.column("sequence_id").to_numpy(), packer.open())
            held = both.filter(pa.array(waiting)).combine_chunks().to_batches()
            yield from both.filter(pa.array(~waiting)).combine_chunks().to_batches()
        if held:
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            made = list(packer.rest(both.column(2).to_pylist()))
            piece, at, length, own, offset = np.asarray(made, np.int64).reshape(-1, 5).T
            p = pa.array(piece)
            data = np.concatenate([np.frombuffer(x, "u1") for x in both.column(3).to_pylist()])
            yield rows(both.column(0).take(p), both.column(1).to_numpy()[piece] + at, length, byte_rows(data, 4 * length), both.column(4).to_numpy()[piece], own, offset)

    return (
        docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
        .mapInArrow(lambda b: released(run(b)), f"id {kind}, {_SCHEMA}")
        .withColumnRenamed("id", id_col)
    )
