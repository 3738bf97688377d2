"""Source divergence audit: how far the words of each source of a language are from the others'.

A task counts the terms of a bounded block of documents by sorting them by term, source and document
and scanning the runs, so a term that every document has leaves a block as one row a source.  Partial counts
are dealt by language and term, sorted by source, and runs scanned again: a run of a term gives its
document frequency and its counts by source.  The terms that stay are scanned once more beside the totals of
all sources, and each task adds up its part of every pair of sources and keeps its best terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .batches import byte_rows, parts, raw_bytes, released, runs
from .bpe import utf8
from .columns import Plain
from .spans import byte_class, classes, segments, spans

#: Documents of its language that a term must be in.
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text in one block of a task.
BLOCK_BYTES = 8 << 20
#: Cells of a task's table of pairs, and of the table of counts that it adds at a time.
CELLS = 1 << 21
#: Rows of kept terms (a term in a source) that a task scans at the end.
BUCKET_ROWS = 100_000

_LETTER = byte_class((97, 122), (128, 255))
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32


def _terms(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    return byte_rows(data[runs(first, size)], size).cast(pa.string())


def _block_counts(data: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a block: group, then number, term, document frequency and occurrences of each term in each group."""
    first, size, row = spans(data, sizes, _LETTER)
    order, new = classes(data, first, size)
    term = np.empty(first.size, np.int64)
    term[order] = np.cumsum(new) - 1
    by_group = np.argsort(group, kind="stable")
    place = np.empty(group.size, np.int64)
    place[by_group] = np.arange(group.size)
    keys = np.sort(term * max(1, group.size) + place[row])  # by term, source and document
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else keys
    n = np.diff(np.append(starts, keys.size))
    of_term, doc = np.divmod(keys[starts], max(1, group.size))
    own = group[by_group][doc]
    runs_at = np.flatnonzero(np.r_[True, (of_term[1:] != of_term[:-1]) | (own[1:] != own[:-1])]) if starts.size else starts
    docs = np.diff(np.append(runs_at, starts.size))
    rep = order[new][of_term[runs_at]]
    return own[runs_at], _terms(data, first[rep], size[rep]), docs, np.add.reduceat(n, runs_at) if runs_at.size else n


def _long_counts(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms and occurrences of one long row, piece by piece; its distinct terms are held."""
    seen: dict[bytes, int] = {}
    for piece in segments(data, _LETTER, BLOCK_BYTES):
        first, size, _ = spans(piece, np.array([piece.size]), _LETTER)
        order, new = classes(piece, first, size)
        at = np.flatnonzero(new)
        n, whole = np.diff(np.append(at, order.size)), piece.tobytes()
        for i, k, c in zip(first[order[at]].tolist(), size[order[at]].tolist(), n.tolist(), strict=True):
            seen[whole[i:i + k]] = seen.get(whole[i:i + k], 0) + c
    return pa.array([x.decode() for x in seen], pa.string()), np.array(list(seen.values()), np.int64)


def block_counts(docs: DataFrame) -> DataFrame:
    """From ``lang, source, text`` (bytes): ``lang, term, source, df, n`` of each block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in parts(batch, 2, BLOCK_BYTES):
                data, sizes = raw_bytes(block.column(2))
                data = _LOWER[data]
                lang, source = (block.column(i).dictionary_encode() for i in (0, 1))
                n_sources = max(1, len(source.dictionary))
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                if sizes.size == 1 and data.size > 2 * BLOCK_BYTES:
                    term, n = _long_counts(data)
                    own, df = np.repeat(group, n.size), np.ones(n.size, np.int64)
                else:
                    own, term, df, n = _block_counts(data, sizes, group)
                columns = [lang.dictionary.take(pa.array(own // n_sources)), term, source.dictionary.take(pa.array(own % n_sources)), pa.array(df, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "df", "n"])

    return docs.select("lang", "source", "text").mapInArrow(lambda b: released(run(b)), "lang string, term string, source string, df bigint, n bigint")


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in one of the columns; the first does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        col = table.column(name)
        out[1:] |= pc.not_equal(col.slice(1), col.slice(0, max(0, table.num_rows - 1))).to_numpy(zero_copy_only=False)
    return out


def _summed(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Sorted rows with equal ``lang, term, source`` as one, and where the terms begin."""
    new = _changes(table, ["lang", "term"])
    at = np.flatnonzero(new | _changes(table, ["source"]))
    out = table.take(pa.array(at))
    for i, name in ((3, "df"), (4, "n")):
        out = out.set_column(i, name, pa.array(np.add.reduceat(table.column(name).to_numpy(), at), pa.int64()))
    return out, np.flatnonzero(new[at])


def kept_terms(partial: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, source, n`` of the terms in at least ``least_docs`` documents of their language;
    ``lead`` marks the first row of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                total = np.add.reduceat(table.column("df").to_numpy(), at)
                keep = np.repeat(total >= least_docs, np.diff(np.append(at, table.num_rows)))
                lead = np.zeros(table.num_rows, bool)
                lead[at] = True
                made = table.drop_columns(["df"]).append_column("lead", pa.array(lead)).filter(pa.array(keep))
                yield from made.combine_chunks().to_batches()

        open_run: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table, at = _summed((table if open_run is None else pa.concat_tables([open_run, table])).combine_chunks())
            yield from out(table.slice(0, at[-1]), at[:-1])
            open_run = table.slice(at[-1])  # one row a source
        if open_run is not None:
            yield from out(open_run, np.zeros(1, np.int64))

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(lambda b: released(run(b)), "lang string, term string, source string, n bigint, lead boolean")


def _weight(count: np.ndarray, total, v: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 v))``, in Python's integers where a long might overflow."""
    if count.size and int(count.max()) > (1 << 62) // SCALE - 2:
        count = count.astype(object)
    return (1 + SCALE * (count + 2) // (total + 2 * v)).astype(np.int64)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Language:
    """What one task adds up for a language: its part of the pairs whose first source is in one block of rows."""

    def __init__(self, bucket: int, block: int, lang: str):
        self.bucket, self.block, self.lang = bucket, block, lang
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.v, self.seen, self.held, self.open = 0, False, [], 0
        self.value_set = None

    def begin(self, rows: pa.Table) -> None:
        self.sources += rows.column("source").to_pylist()
        self.totals += rows.column("n").to_pylist()
        self.v = rows.column("v")[0].as_py()

    def _ready(self) -> None:
        if self.value_set is None:
            s = len(self.sources)
            height = max(1, CELLS // s)
            self.value_set = pa.array(self.sources, pa.string())
            self.total = np.array(self.totals, np.int64)
            self.rows = np.arange(min(s, self.block * height), min(s, (self.block + 1) * height))
            self.pairs = np.zeros((self.rows.size, s), np.int64)
            self.best: list[tuple[np.ndarray, list[str]]] = [(np.zeros(0, np.int64), [])] * self.rows.size

    def add(self, rows: pa.Table) -> None:
        """Rows of terms in order; the last one's run may go on."""
        self._ready()
        self.seen = True
        if not self.rows.size:
            return
        self.held.append(rows)
        self.open += rows.num_rows
        if self.open * len(self.sources) >= CELLS:
            self._count(False)

    def _count(self, last: bool) -> None:
        if not self.held:
            return
        table = pa.concat_tables(self.held).combine_chunks()
        new = np.flatnonzero(_changes(table, ["term"]))
        if not last:
            table, rest = table.slice(0, new[-1]), table.slice(new[-1])
            self.held, self.open, new = [rest], rest.num_rows, new[:-1]
        else:
            self.held, self.open = [], 0
        step = max(1, CELLS // len(self.sources))
        for a in range(0, new.size, step):
            b = min(new.size, a + step)
            self._block(table.slice(new[a], (new[b] if b < new.size else table.num_rows) - new[a]), new[a:b] - new[a])

    def _block(self, table: pa.Table, at: np.ndarray) -> None:
        source = pc.index_in(table.column("source"), value_set=self.value_set).to_numpy().astype(np.int64)
        term = np.zeros(table.num_rows, np.int64)
        term[at] = 1
        count = np.zeros((len(self.sources), at.size), np.int64)
        count[source, np.cumsum(term) - 1] = table.column("n").to_numpy()
        names = table.column("term").take(pa.array(at))
        p = np.stack([_weight(c, int(n), self.v) for c, n in zip(count, self.total, strict=True)])
        q = _weight(count.sum(axis=0), int(self.total.sum()), self.v)
        for k, i in enumerate(self.rows):
            for j in range(p.shape[0]):
                if i != j:
                    self.pairs[k, j] += int(_distance(p[i], p[j]).sum())
            over = np.flatnonzero((count[i] > 0) & (p[i] > q))
            f = _distance(p[i][over], q[over])
            own = np.argsort(-f, kind="stable")[:TOP_TERMS]  # terms come in order, so the first of equals stays
            value = np.concatenate([self.best[k][0], f[own]])
            items = self.best[k][1] + names.take(pa.array(over[own])).to_pylist()
            top = np.argsort(-value, kind="stable")[:TOP_TERMS]
            self.best[k] = value[top], [items[x] for x in top]

    def end(self) -> Iterator[pa.RecordBatch]:
        self._ready()
        self._count(True)
        if not self.seen and self.bucket:
            return  # nothing to add; that pairs without terms are there is said once, by the first bucket
        for k, i in enumerate(self.rows.tolist()):
            others = [j for j in range(len(self.sources)) if j != i]
            items = [self.sources[j] for j in others] + self.best[k][1]
            value = np.concatenate([self.pairs[k, others], self.best[k][0]])
            part = ["pair"] * len(others) + ["term"] * len(self.best[k][1])
            columns = [pa.array([self.lang] * len(items), pa.string()), pa.array([self.sources[i]] * len(items), pa.string()), pa.array(part, pa.string()), pa.array(items, pa.string()), pa.array(value, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def partial_values(terms: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """``lang, source, part, item, value``: parts of the values of pairs, and best terms, of each task.

    ``groups`` (``lang, source, n, v``) goes to every bucket of terms, before its terms.  Where a
    language has so many sources that a table of their pairs would be large, its rows are dealt to blocks that
    scan the terms each for themselves, so the work follows the number of pairs that are asked for.
    """
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-most // max(1, CELLS // most)) - 1))).alias("block")
    own = terms.select(F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int").alias("bucket"), "lang", F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("bigint").alias("v"))
    head = groups.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "lang", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", "n", "v")
    every = own.unionByName(head).select("*", blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = np.flatnonzero(_changes(table, ["bucket", "block", "lang"]))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], strict=True):
                own = table.slice(a, b - a)
                which = tuple(own.column(c)[0].as_py() for c in ("bucket", "block", "lang"))
                if now is None or which != (now.bucket, now.block, now.lang):
                    if now is not None:
                        yield from now.end()
                    now = _Language(*which)
                n = int(np.searchsorted(own.column("kind").to_numpy(), 1))
                if n:
                    now.begin(own.slice(0, n))
                if n < own.num_rows:
                    now.add(own.slice(n))
        if now is not None:
            yield from now.end()

    dealt = every.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "lang", "kind", "term", "source")
    return dealt.mapInArrow(lambda b: released(run(b)), "lang string, source string, part string, item string, value bigint")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the distance of every source of a language to each
    other one (``part`` is ``pair``), and the ten terms by which it stands out (``term``).

    A term is a run of letters and of characters beyond ASCII, A to Z in lower case; those in at least
    ``least_docs`` rows of a language count.  A null text, language or source is the empty string.  Every row
    is a document of its own, also one that repeats another.  A source without terms has its
    pairs; a source alone in its language has none; of equal values the smaller item (in UTF-8) comes
    first.  Other columns are ignored, whatever their names; an empty table gives no rows.  Counts of
    terms are written to the shared folder when this is called.
    """
    plain = Plain(docs)
    lang, source = (F.coalesce(F.col(plain.at(c)).cast("string"), F.lit("")) for c in (lang_col, source_col))
    own = plain.df.select(lang.alias("lang"), source.alias("source"), utf8(plain.at(text_col)).alias("text"))
    terms = stored(kept_terms(block_counts(own), least_docs), "divergence-terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("lead").alias("leads"))
    every = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    v = F.coalesce(F.sum("leads").over(Window.partitionBy("lang")), F.lit(0))
    groups = stored(every.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), v.alias("v")), "divergence-groups")
    # every bucket gives all pairs a part of their value, so there are as many as the terms need
    buckets = max(1, -(-terms.count() // BUCKET_ROWS))
    parts_ = partial_values(terms.drop("lead"), groups, buckets)
    values = parts_.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
