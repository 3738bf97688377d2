"""Many strings at once: texts are walked through an automaton, one step a character.

The strings are a dimension: their number and size are checked before the automaton that finds them
all (its states are their common beginnings, with links to the longest ending that is one too) is sent to the tasks.
So a text is read once, however many strings there are, and no text is held against each string.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings of an automaton, and their characters altogether.
MOST_STRINGS = 20_000
MOST_CHARS = 4_000_000


def dimension(rows: DataFrame, column: str, most: int = MOST_STRINGS) -> list[str]:
    """The distinct strings of a column, which are checked to be few; more are an error."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} strings in a dimension")
    return sorted(r[0] for r in found)


def automaton(strings: list[str]):
    """The automaton of the strings; a string's value is its first place in the list.  Empty ones are never found."""
    if len(strings) > MOST_STRINGS or sum(map(len, strings)) > MOST_CHARS:
        raise ValueError(f"more than {MOST_STRINGS} strings or {MOST_CHARS} characters for one automaton")
    out = ahocorasick.Automaton()
    for i in reversed(range(len(strings))):
        if strings[i]:
            out.add_word(strings[i], i)
    if len(out):
        out.make_automaton()
    return out


def _sent(docs: DataFrame, strings: list[str]):
    return docs.sparkSession.sparkContext.broadcast((automaton(strings), strings))


def hits(docs: DataFrame, text_col: str, strings: list[str], keep: list[str]) -> DataFrame:
    """``keep``, and for each string that a text has: ``string``, its first place (``at``, 1-based, in characters) and how
    often it occurs (``n``, counting occurrences that overlap).  A null or empty text has none."""
    sent = _sent(docs, strings)
    held = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = sent.value
        for batch in batches:
            rows, strings_, at, n = [], [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                found: dict[int, list[int]] = {}
                for end, which in find.iter(t) if t and len(find) else ():
                    found.setdefault(which, [end + 2 - len(names[which]), 0])[1] += 1
                for which in sorted(found):
                    rows.append(i)
                    strings_.append(names[which])
                    at.append(found[which][0])
                    n.append(found[which][1])
            own = batch.select(range(len(keep))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(strings_, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], [*keep, "string", "at", "n"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{held}{', ' if held else ''}string string, at int, n bigint")


def first_of(docs: DataFrame, text_col: str, strings: list[str], string: str = "term", at: str = "at") -> DataFrame:
    """``docs`` with the first of ``strings`` (in their order) that a text has, and its first place; null and 0 where
    it has none."""
    sent = _sent(docs, strings)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = sent.value
        for batch in batches:
            which, where = [], []
            for t in batch.column(place).to_pylist():
                best, begin = None, 0
                for end, i in find.iter(t) if t and len(find) else ():
                    if best is None or i < best:
                        best, begin = i, end + 2 - len(names[i])
                which.append(None if best is None else names[best])
                where.append(begin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which, pa.string()), pa.array(where, pa.int32())], [*batch.schema.names, string, at])

    return docs.mapInArrow(run, f"{kinds}, `{string}` string, `{at}` int")
