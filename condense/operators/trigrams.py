"""Regular expressions through an index of trigrams.

A text that a pattern matches holds certain runs of three bytes.  :func:`needs` reads them off the pattern
as a boolean query; the index (``gram, id``, one row a trigram and text) answers it with one
aggregation over the postings of these trigrams, and only the texts that are left are read and
searched.  The query never rules out a match: whatever is not understood asks for nothing.

Bytes are those of UTF-8 with A to Z in lower case.  Patterns match in any case, of other letters too, so a pattern's
other letters are not looked up; the two that match an ASCII letter are written as it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a part of a pattern may stand for and still be listed one by one, and trigrams of a query.
MOST_STRINGS = 24
MOST_GRAMS = 60
#: Bytes of text that a task takes apart at a time.
BLOCK_BYTES = 4 << 20

#: Patterns match in any case.
IN_ANY_CASE = "(?iu)"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32

#: A boolean query: ``True`` (nothing is needed), a trigram, or ``("and" | "or", [queries])``.
Query = bool | int | tuple


def grams_of(data: bytes) -> list[int]:
    """The trigrams of a run of bytes, each once, in order."""
    low = data.lower()
    return list(dict.fromkeys(low[i] << 16 | low[i + 1] << 8 | low[i + 2] for i in range(len(low) - 2)))


def postings(docs: DataFrame, id_col: str = "hash", text_col: str = "content") -> DataFrame:
    """``gram, id``: every trigram of every text, once a text; nothing is shuffled.  Null texts have none."""
    plain = F.when(F.col(text_col).rlike("[\u017f\u212a]"), F.translate(text_col, "\u017f\u212a", "sk")).otherwise(F.col(text_col))
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), plain.cast("binary").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for i, t in enumerate(batch.column(1)):
                b = _LOWER[np.frombuffer(t.as_buffer(), np.uint8)]
                g = np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if b.size > 2 else b[:0]
                found.append((i, g))
                size += g.size
                if size * 4 > BLOCK_BYTES or i == batch.num_rows - 1:
                    at = np.repeat([k for k, _ in found], [x.size for _, x in found]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x in found]).astype(np.int32)), batch.column(0).take(pa.array(at))], ["gram", "id"])
                    found, size = [], 0

    return own.mapInArrow(run, f"gram int, id {kind}")


def sorted_by_gram(index: DataFrame) -> DataFrame:
    """The index in ranges of trigrams: written so, a reader of few trigrams skips all other row groups."""
    return index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    parts = [x for q in (a, b) for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])]
    return ("and", list(dict.fromkeys(map(_key, parts)))) if len(set(map(_key, parts))) > 1 else parts[0]


def either(queries: list[Query]) -> Query:
    if not queries or any(q is True for q in queries):
        return True
    parts = list(dict.fromkeys(_key(x) for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])))
    return ("or", parts) if len(parts) > 1 else parts[0]


def _key(q: Query) -> Query:
    return (q[0], tuple(q[1])) if isinstance(q, tuple) else q


def needed_of(strings: set[bytes]) -> Query:
    """What a text with at least one of the strings needs."""
    out = []
    for s in sorted(strings):
        q: Query = True
        for g in grams_of(s):
            q = both(q, g)
        out.append(q)
    return either(out)


class _Part:
    """What is known of a part of a pattern: all strings that it stands for (or None), how they begin and end, and
    what a text with one of them needs."""

    def __init__(self, exact: set[bytes] | None = None, begins: set[bytes] | None = None, ends: set[bytes] | None = None, needs: Query = True):
        if exact is not None and len(exact) > MOST_STRINGS:
            begins, ends, needs, exact = exact, exact, needed_of(exact), None
        self.exact, self.needs = exact, needs
        self.begins = exact if exact is not None else _shortened(begins or {b""}, slice(0, 2))
        self.ends = exact if exact is not None else _shortened(ends or {b""}, slice(-2, None))

    def closed(self) -> Query:
        return self.needs if self.exact is None else needed_of(self.exact)


def _shortened(strings: set[bytes], part: slice) -> set[bytes]:
    """Beginnings (or ends) of two bytes; none is known where there are too many."""
    out = {s[part] for s in strings}
    return {b""} if b"" in out or len(out) > MOST_STRINGS else out


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Part({x + y for x, y in itertools.product(a.exact, b.exact)})
    needs = both(a.closed(), b.closed())
    if len(a.ends) * len(b.begins) <= MOST_STRINGS:
        # a text with both has an end of the one before a beginning of the other
        needs = both(needs, needed_of({x + y for x, y in itertools.product(a.ends, b.begins)}))
    begins = {x + y for x in a.exact for y in b.begins} if a.exact is not None else a.begins
    ends = {x + y for x in a.ends for y in b.exact} if b.exact is not None else b.ends
    return _Part(None, begins, ends, needs)


def _one_of(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return _Part(set().union(*(p.exact for p in parts)))
    begins, ends = (set().union(*x) for x in ([p.begins for p in parts], [p.ends for p in parts]))
    return _Part(None, begins, ends, either([p.closed() for p in parts]))


_ANY = _Part(None)


def _char(code: int) -> _Part:
    return _Part({bytes([code]).lower()}) if code < 128 else _ANY


def _read(tree) -> _Part:
    out = _Part({b""})
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = _char(arg)
        elif name == "IN":
            listed = [v for o, v in arg if str(o) == "LITERAL"]
            part = _one_of([_char(v) for v in listed]) if len(listed) == len(arg) <= MOST_STRINGS else _ANY
        elif name == "BRANCH":
            part = _one_of([_read(x) for x in arg[1]])
        elif name == "SUBPATTERN":
            part = _ANY if arg[1] or arg[2] else _read(arg[3])
        elif name == "ATOMIC_GROUP":
            part = _read(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            part = _read(inner)
            if (low, high) == (0, 1):
                part = _one_of([part, _Part({b""})])
            elif low == 0:
                part = _ANY
            elif (low, high) != (1, 1):
                once = part
                for _ in range(min(low, 4) - 1):
                    once = _joined(once, part)
                exact = low == high and low <= 4
                part = once if exact else _Part(None, once.begins, once.ends, once.closed())
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = _Part({b""})
        else:
            part = _ANY
        out = _joined(out, part)
    return out


def needs(pattern: str) -> Query:
    """What a text needs for ``pattern`` to be found in it, whatever the case of ASCII letters.

    The pattern is read as Python reads it; where other dialects mean something else (octal escapes,
    intersections of classes, flags other than ``i``, ``s`` and ``m``) or Python cannot read it, nothing is needed.
    """
    if re.search(r"\\[0-9xX]|&&|\\[QEGhHRvVzkKpPcCe]|\[[^\]]*\[|#", pattern):
        return True
    try:
        tree = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError, AttributeError):
        return True
    if tree.state.flags & ~(re.I | re.S | re.M | re.U):
        return True
    return _few(_read(tree).closed())


def _few(q: Query, most: int = MOST_GRAMS) -> Query:
    """A query of at most ``most`` trigrams that rules out no more: conjuncts beyond are left out."""
    if not isinstance(q, tuple):
        return q
    if q[0] == "or":
        share = [_few(x, most // len(q[1])) for x in q[1]]
        return either(share) if most >= len(q[1]) else True
    out, left = [], most
    for x in sorted(q[1], key=lambda x: isinstance(x, tuple)):
        n = len(listed(x))
        if n <= left:
            out.append(x)
            left -= n
    return ("and", out) if len(out) > 1 else out[0] if out else True


def listed(q: Query) -> list[int]:
    """All trigrams of a query."""
    if isinstance(q, tuple):
        return list(dict.fromkeys(g for x in q[1] for g in listed(x)))
    return [] if isinstance(q, bool) else [q]


def _holds(q: Query, have: Column) -> Column:
    if isinstance(q, tuple):
        parts = [_holds(x, have) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out
    return F.array_contains(have, F.lit(q))


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """``id`` of the texts that have what ``pattern`` needs; None where it needs nothing.  Only postings of
    the query's trigrams are read and shuffled, and no group has more of them than the query."""
    q = needs(pattern)
    if q is True:
        return None
    grams = listed(q)
    have = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.collect_set("gram").alias("have"))
    return have.where(_holds(q, F.col("have"))).select("id")


def search(docs: DataFrame, index: DataFrame, pattern: str, id_col: str = "hash", text_col: str = "content") -> DataFrame:
    """Rows of ``docs`` whose text the pattern matches, reading only candidates of the index (all texts where the pattern
    needs no trigram)."""
    found = candidates(index, pattern)
    some = docs if found is None else docs.join(found.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return some.where(F.col(text_col).rlike(IN_ANY_CASE + pattern))
