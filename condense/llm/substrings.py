"""Removal of word passages that occur earlier, by prefix-partitioned suffix trees.

Every window of ``LENGTH`` words has an anchor: the place in it at which the hash of the next
``LENGTH / 2`` words is least, so equal windows have equal anchors.  The suffixes that begin at
anchors, with the words before them, make up a sparse suffix tree that holds every repeat of
``LENGTH`` words.

The tree is built in parts.  First all prefixes of half the length are counted: a branch with one
leaf can hold no repeat and goes.  Branches are split by prefix into groups that fit in memory, and
each group's subtree is built level by level, forwards and backwards from the anchors; a node that
is ``LENGTH`` words deep in both directions together and has several leaves is part of a maximal
repeat, of which the earliest leaf stays.  A prefix with more than ``LEAVES`` leaves would not fit:
it is lengthened to whole windows, whose branches have the leaves of one node only.

Documents are dealt into chunks.  A chunk sends each different prefix, and each different context of
an anchor, once, however often it has it, and gets back one number for it, in the order in which it
was sent.  So no group grows with the copies of a passage, and texts travel once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import exchange
from . import wordhash as wh
from .batches import trimmed
from .columns import Plain

LENGTH = 20
#: Text in one chunk; a chunk is held by one task.
CHUNK_BYTES = 6 << 20
#: Leaves below a prefix from which it is lengthened.
LEAVES = 4096
#: Bytes of a word's hash in the words around an anchor.
SYMBOL = 6
_NONE = np.iinfo(np.int64).min  # stands for a null id, before all others
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_ALONE, _SHARED, _HOT = range(3)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.ones(keys[0].size, bool)
    if out.size:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


class _Chunk:
    """Words, anchors and their contexts in one chunk's documents, in the order of their ids."""

    def __init__(self, table: pa.Table, ids: str, text: str, order: str, length: int):
        self.length, self.half = length, max(1, length // 2)
        own = pc.fill_null(table.column(ids).cast(pa.int64()), _NONE).to_pylist()
        texts = pc.fill_null(table.column(text), b"").to_pylist()
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(own, table.column(order).to_pylist(), texts, strict=True)):
            rows.setdefault(key, []).append(i)  # rows that repeat id and text are one document
        self.keys = sorted(rows)
        self.rows = [rows[k] for k in self.keys]
        self.ids = np.asarray([k[0] for k in self.keys], np.int64)
        self.order = np.asarray([k[1] for k in self.keys], np.int64)
        self.words, self.counts = wh.words([k[2] for k in self.keys])
        self.windows = wh.Windows(self.words)
        self.starts, self.owner = wh.window_starts(self.counts, length)
        self._anchors()

    def _anchors(self) -> None:
        """The anchor of each window, and the different contexts of anchors in the order of their
        prefixes.  The windows of an anchor begin at neighbouring places."""
        n, width = self.words.size, self.length - self.half + 1
        if not self.starts.size:
            self.anchor = self.run = self.run_of = self.context = self.first = np.zeros(0, np.int64)
            self.mask = self.prefix = self.prefixes = np.zeros(0, _U)
            self.leaves = self.prefix_of = self.far = self.near = np.zeros(0, np.int64)
            return
        hashes = self.windows.hashes(np.arange(n - self.half + 1), self.half)
        least = wh.sliding(hashes, width)
        offset = np.zeros(least.size, np.int64)
        for o in range(width - 1, 0, -1):
            offset[hashes[o:o + least.size] == least] = o
        offset[hashes[:least.size] == least] = 0
        self.anchor = self.starts + offset[self.starts]
        begins = _new(self.anchor)
        run = np.flatnonzero(begins)
        self.run_of = np.cumsum(begins) - 1
        last = np.append(run[1:], self.anchor.size) - 1
        self.run = self.anchor[run]
        far, near = self.run - self.starts[run], self.run - self.starts[last]  # largest and least offset
        self.mask = (_U(2) << far.astype(_U)) - (_U(1) << near.astype(_U))
        self.prefix = hashes[self.run]
        span = self.windows.hashes(self.run - far, far - near + self.length)
        span = wh.mix(span * _ODD + (far * 64 + near).astype(_U))
        order = np.lexsort((self.run, span, self.prefix))
        new = _new(self.prefix[order], span[order])
        self.first = order[new]  # the earliest anchor with each context
        self.context = np.empty(order.size, np.int64)
        self.context[order] = np.cumsum(new) - 1
        self.far, self.near = far, near
        other = _new(self.prefix[self.first])
        self.prefixes = self.prefix[self.first][other]
        self.prefix_of = np.cumsum(other) - 1  # of each context
        self.leaves = np.diff(np.append(np.flatnonzero(other), self.first.size))

    def take(self, kinds: np.ndarray) -> None:
        """Contexts below prefixes that are shared, and windows below those that are hot."""
        kind = kinds[self.prefix_of]
        self.kind = kind[self.context]  # of each anchor
        self.shared = np.flatnonzero(kind == _SHARED)
        self.hot = np.flatnonzero(self.kind[self.run_of] == _HOT) if self.run_of.size else np.zeros(0, np.int64)
        start = self.starts[self.hot]
        a, b = self.windows.hashes(start, self.length), self.windows.hashes(start, self.length, 1)
        order = np.lexsort((np.arange(a.size), b, a))
        new = _new(a[order], b[order])
        self.hot_first = order[new]
        self.node_of = np.empty(a.size, np.int64)
        self.node_of[order] = np.cumsum(new) - 1
        self.a, self.b = a[self.hot_first], b[self.hot_first]

    def around(self) -> np.ndarray:
        """The words before (nearest first) and behind the prefix of each shared context, as far as its
        windows reach."""
        at = self.first[self.shared]
        place, far, near = (x[at][:, None] for x in (self.run, self.far, self.near))
        back = np.arange(self.half)[None, :]
        ahead = np.arange(self.length - self.half)[None, :]
        out = np.zeros((at.size, self.length), _U)
        padded = np.append(self.words, _U(0))
        end = self.words.size
        out[:, :self.half] = padded[np.where(back < far, place - 1 - back, end)]
        out[:, self.half:] = padded[np.where(ahead < self.length - near - self.half, place + self.half + ahead, end)]
        return np.ascontiguousarray(out.view("u1").reshape(at.size, self.length, 8)[:, :, :SYMBOL]).reshape(at.size, self.length * SYMBOL)

    def sent(self, n: int, chunk: int) -> pa.Table:
        at = self.first[self.shared]
        window = self.hot[self.hot_first] if self.hot.size else self.hot
        doc_of = lambda place: np.searchsorted(np.cumsum(self.counts), place, "right")
        parts = []
        for first, values, second, place, words in (
            (0, self.prefix[at], self.mask[at], self.run[at], self.around()),
            (n, self.a, self.b, self.starts[window], np.zeros((window.size, 0), "u1")),
        ):
            doc = doc_of(place)
            t = exchange.packed(values, n, chunk, second=second, ids=self.ids[doc], order=self.order[doc], place=place.astype("<u4"), words=words)
            parts.append(t.set_column(0, "group", pc.add(t.column("group"), pa.scalar(first, pa.int32()))))
        return pa.concat_tables(parts)

    def covered(self, answers: np.ndarray) -> np.ndarray:
        """Words in windows that begin earlier too; ``answers``: for each shared context the offsets of such
        windows, for each hot window whether it is one."""
        own, gone = np.zeros(self.first.size, _U), np.zeros(self.starts.size, bool)
        own[self.shared] = answers[:self.shared.size]
        if self.run.size:
            flags = self.mask.copy()  # all windows of a context that the chunk has had before
            flags[self.first] = own
            flags[self.kind == _HOT] = 0
            gone = (flags[self.run_of] >> (self.anchor - self.starts).astype(_U) & _U(1)).astype(bool)
        later = np.ones(self.hot.size, bool)
        later[self.hot_first] = answers[self.shared.size:] > 0
        gone[self.hot[later]] = True
        edge = np.zeros(self.words.size + 1, np.int64)
        starts = self.starts[gone]
        edge[starts] += 1
        np.add.at(edge, starts + self.length, -1)
        return np.cumsum(edge)[:-1] > 0


def _branches(node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The nodes one level below: a number for each different pair."""
    return np.unique(wh.mix(node.astype(_U) * _ODD + symbol), return_inverse=True)[1]


def later_leaves(prefix: np.ndarray, mask: np.ndarray, ids: np.ndarray, order: np.ndarray, place: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each context the offsets (bits) of windows that an earlier context of the group has too.
    ``words``: symbols before and behind the prefix, as :meth:`_Chunk.around` gives them."""
    half = max(1, length // 2)
    back = [np.zeros(prefix.size, np.int64)]  # nodes of the tree of reversed words before the anchors
    for d in range(half):
        back.append(_branches(back[-1], words[:, d]))
    ahead = np.unique(prefix, return_inverse=True)[1]
    out = np.zeros(prefix.size, _U)
    depth = half
    for o in range(length - half, -1, -1):
        while depth < length - o:
            ahead = _branches(ahead, words[:, depth])  # one word deeper; words behind the prefix stand from ``half`` on
            depth += 1
        has = np.flatnonzero(mask >> _U(o) & _U(1)) if o <= half else np.zeros(0, np.int64)
        node = _branches(ahead[has], back[min(o, half)][has].astype(_U))
        at = np.lexsort((place[has], order[has], ids[has], node))
        new = _new(node[at])
        out[has[at[~new]]] |= _U(1) << _U(o)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, leaves: int = LEAVES) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts earlier: in a
    document with a smaller id, or in the same document before.

    Returns the columns of ``docs`` with ``n_words bigint, n_removed bigint, kept string`` (the
    kept words joined by one space).  Windows are judged on the input.  A null text has no words;
    documents of fewer than ``length`` words lose none; rows that repeat id and text are one
    document and fare alike; texts of one id are ordered by a hash; a null id comes first; an empty
    table gives no rows.  Columns of ``docs`` with the names of the new ones are replaced; all
    others, whatever their names, stay.  Ids are integers; ``length`` is even and at most 120.
    Equal prefixes are told by a 64-bit hash, the words around them by 48 bits each, and windows
    below a prefix with more than ``leaves`` contexts by two 64-bit hashes.
    """
    if length % 2 or not 2 <= length <= 120:
        raise ValueError("length must be even, and at most 120")
    plain = Plain(docs)
    key_id, text = plain.at(id_col), plain.at(text_col)
    size = plain.df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = int(max(1, -(-size // CHUNK_BYTES), 2 * docs.sparkSession.sparkContext.defaultParallelism))
    order = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # the three passes below read all columns, so that Spark makes this exchange once for them
    texts = plain.df.withColumn("order", order).withColumn(text, F.col(text).cast("binary"))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64(key_id, "order"), F.lit(n)).cast("int")).repartition(n, "chunk")
    chunk_of = lambda table: _Chunk(table, key_id, text, "order", length)

    def prefixes(key: tuple, table: pa.Table) -> pa.Table:
        c = chunk_of(table)
        return trimmed(exchange.packed(c.prefixes, n, key[0].as_py(), leaves=np.minimum(c.leaves, 0xFFFF).astype("<u2")))

    def kinds(table: pa.Table) -> pa.Table:
        values, sizes = exchange.received(table, "values", "<u8")
        own, _ = exchange.received(table, "leaves", "<u2")
        _, at = np.unique(values, return_inverse=True)
        total = np.bincount(at, own)[at]
        return exchange.reply(table, sizes, np.where(total > leaves, _HOT, np.where(total > 1, _SHARED, _ALONE)).astype("u1"))

    def contexts(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        c = chunk_of(table)
        c.take(exchange.replied(replies, "u1", c.prefixes.size))
        return trimmed(c.sent(n, key[0].as_py()))

    def subtree(key: tuple, table: pa.Table) -> pa.Table:
        kind = {"values": "<u8", "second": "<u8", "ids": "<i8", "order": "<i8", "place": "<u4"}
        values, sizes = exchange.received(table, "values", "<u8")
        _, second, ids, order, place = (exchange.received(table, x, k)[0] for x, k in kind.items())
        if key[0].as_py() >= n:  # whole windows
            at = np.lexsort((place, order, ids, second, values))
            flags = np.zeros(values.size, _U)
            flags[at] = ~_new(values[at], second[at])
            return exchange.reply(table, sizes, flags)
        raw, _ = exchange.received(table, "words", "u1")
        words = np.zeros((values.size, length, 8), "u1")
        words[:, :, :SYMBOL] = raw.reshape(values.size, length, SYMBOL)
        return exchange.reply(table, sizes, later_leaves(values, second, ids, order, place, words.view("<u8")[:, :, 0], length))

    answer = "chunk int, group int, numbers binary"
    first = texts.groupBy("chunk").applyInArrow(prefixes, "group int, chunk int, values binary, leaves binary")
    first = first.groupBy("group").applyInArrow(kinds, answer)
    second = texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(
        contexts, "group int, chunk int, values binary, second binary, ids binary, order binary, place binary, words binary"
    )
    second = second.groupBy("group").applyInArrow(subtree, answer)
    columns = plain.columns
    out = T.StructType(list(plain.df.schema.fields)).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    out_schema = to_arrow_schema(out)

    def cut(table: pa.Table, kinds: pa.Table, flags: pa.Table) -> pa.Table:
        c = chunk_of(table)
        c.take(exchange.replied(kinds, "u1", c.prefixes.size))
        gone = c.covered(exchange.replied(flags, "<u8", c.shared.size + c.hot_first.size))
        ends = np.cumsum(c.counts)
        kept: list = [None] * table.num_rows
        n_words, n_removed = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        for (*_, body), rows, end, count in zip(c.keys, c.rows, ends.tolist(), c.counts.tolist(), strict=True):
            own = gone[end - count:end]
            words = body.split()
            body = b" ".join(w for w, g in zip(words, own.tolist(), strict=True) if not g) if own.any() else b" ".join(words)
            for r in rows:
                kept[r], n_words[r], n_removed[r] = body, count, own.sum()
        more = [pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())]
        own = [table.column(x).cast(pa.string()) if x == text else table.column(x) for x in columns]
        return trimmed(pa.table([*own, *more], names=[*columns, "n_words", "n_removed", "kept"]))

    # both answers of a chunk come in one table, told apart by ``step``
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))

    def final(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        step = answers.column("step")
        return cut(table, answers.filter(pc.equal(step, 1)), answers.filter(pc.equal(step, 2)))

    done = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(final, out)
    return plain.restored(done, added={x: F.col(x) for x in ("n_words", "n_removed", "kept")})
