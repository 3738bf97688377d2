"""Exact duplicates by the owners of compressed radix tries.

Each task puts the texts of a bounded block into a trie first, so a text with very many copies
leaves a block as one entry.  Entries are dealt by the length and a hash of their bytes to owners,
which put the full bytes into tries of their own: texts are equal only where a walk ends at the
same node.  An owner gets its entries sorted by length and hash, so a subtree that the order has
passed is complete; when the trie is full, complete subtrees are put out and freed (the sort
itself is Spark's and goes to disk).  A terminal node holds the identifier that stays.

What comes back to the rows of a block is one number an entry, so no group is joined by its text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .batches import parts, released
from .bpe import utf8
from .columns import Plain

#: Bytes of text in one block of a task.
BLOCK_BYTES = 16 << 20
#: Bytes that an owner's trie holds before complete subtrees are put out.
TRIE_BYTES = 32 << 20
#: Bits of the number of a row or entry within its task.
_TASK_BITS = 36


class Trie:
    """A compressed radix trie of byte strings; its terminal nodes hold a value each."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def node(self, key: bytes) -> list:
        """The node of ``key``, made where there is none: ``[label, children by first byte, value]``."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.bytes += len(key) - at + 300
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            self.bytes += 300
            node, at = middle, at + same
        return node

    def values(self) -> Iterator:
        """The values of all terminal nodes."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[2] is not None:
                yield node[2]
            todo.extend(node[1].values())


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common beginning of ``label`` and ``key[at:]``, by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label[low:half] == key[at + low:at + half]:
            low = half
        else:
            high = half - 1
    return low


def _better(a: tuple, b: tuple) -> bool:
    """Whether ``a`` (identifier, place) stays rather than ``b``: a larger identifier, none being the
    least, and of equal ones the first place."""
    if a[0] is None or b[0] is None or a[0] == b[0]:
        return (b[0] is None and a[0] is not None) or (a[0] == b[0] and a[1] < b[1])
    return a[0] > b[0]


def blocks(docs: DataFrame, fold_case: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """From ``id, text`` (bytes), rows of two kinds.  Of each document: ``entry, id, place, sha``.  Of each
    distinct text of a block: ``entry, text, length, hash, id, place, n``, where ``id`` and ``place``
    are of the row that stays and ``n`` counts the block's copies."""
    kind = docs.schema["id"].dataType.simpleString()
    id_type: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, rows, entries = TaskContext.get().partitionId() << _TASK_BITS, 0, 0
        for batch in batches:
            id_type[:] = [batch.schema.field("id").type]
            for block in parts(batch, 1, block_bytes):
                trie, own, shas, texts = Trie(), [], [], []
                ids = block.column(0).to_pylist()
                for i, text in zip(ids, block.column(1).to_pylist(), strict=True):
                    text = text.lower() if fold_case else text  # of bytes: A to Z only
                    node = trie.node(text)
                    if node[2] is None:
                        node[2] = [base + entries, (i, base + rows), 1, hashlib.sha256(text).digest()]
                        entries += 1
                        texts.append((node[2], text))
                    else:
                        node[2][2] += 1
                        if _better((i, base + rows), node[2][1]):
                            node[2][1] = (i, base + rows)
                    own.append(node[2][0])
                    shas.append(node[2][3])
                    rows += 1
                n = len(own)
                yield _batch(id_type[0], own, ids, range(base + rows - n, base + rows), shas, [None] * n, [None] * n, [None] * n, [None] * n)
                yield _batch(id_type[0], [v[0] for v, _ in texts], [v[1][0] for v, _ in texts], [v[1][1] for v, _ in texts], [None] * len(texts), [t for _, t in texts],
                             [len(t) for _, t in texts], [int.from_bytes(v[3][:8], "big", signed=True) for v, _ in texts], [v[2] for v, _ in texts])

    return docs.mapInArrow(lambda b: released(run(b)), f"entry bigint, id {kind}, place bigint, sha binary, text binary, length bigint, hash bigint, n bigint")


def _batch(id_type: pa.DataType, entry, ids, place, sha, text, length, hash_, n) -> pa.RecordBatch:
    cols = [(entry, pa.int64()), (ids, id_type), (place, pa.int64()), (sha, pa.binary()), (text, pa.binary()), (length, pa.int64()), (hash_, pa.int64()), (n, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in cols], ["entry", "id", "place", "sha", "text", "length", "hash", "n"])


def owners(entries: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``entry, keep_id, keep_place, group_size`` of each entry of :func:`blocks`."""
    kind = entries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, id_type = Trie(), None, None

        def out(done: Trie) -> Iterator[pa.RecordBatch]:
            rows = [(e, v[0][0], v[0][1], v[1]) for v in done.values() for e in v[2]]
            for at in range(0, len(rows), 50_000):
                a, b, c, d = zip(*rows[at:at + 50_000], strict=True)
                columns = [pa.array(a, pa.int64()), pa.array(b, id_type), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["entry", "keep_id", "keep_place", "group_size"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in parts(batch, 6, BLOCK_BYTES):
                for length, hash_, entry, i, place, n, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    prefix = struct.pack(">qq", length, hash_)
                    if prefix != last and trie.bytes > trie_bytes:  # the order has passed all subtrees that are held
                        yield from out(trie)
                        trie = Trie()
                    last = prefix
                    node = trie.node(prefix + text)
                    if node[2] is None:
                        node[2] = [(i, place), n, [entry]]
                        continue
                    node[2][1] += n
                    node[2][2].append(entry)
                    if _better((i, place), node[2][0]):
                        node[2][0] = (i, place)
        yield from out(trie)

    dealt = entries.select("length", "hash", "entry", "id", "place", "n", "text").repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(lambda b: released(run(b)), f"entry bigint, keep_id {kind}, keep_place bigint, group_size bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id`` (the id of the row that stays of its equals),
    ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are, with A to Z in lower case (``fold_case``).  A null text is
    empty.  The largest id stays; a null id is less than any, and where rows repeat the largest id
    (or all have none), one of them stays.  Other columns are ignored, whatever their names; an empty
    table gives no rows.  Blocks are written to the shared folder when this is called.
    """
    plain = Plain(docs)
    own = plain.df.select(F.col(plain.at(id_col)).alias("id"), utf8(plain.at(text_col)).alias("text"))
    both = stored(blocks(own, fold_case), "exact-blocks")  # numbers of entries must not change between the two readers
    kept = owners(both.where("length is not null"))
    rows = both.where("length is null").select("entry", "id", "place", "sha")
    joined = rows.join(kept, "entry")
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
