"""Joins of intervals: which ranges of lines, times or numbers overlap, key by key.

Every interval has a level by its length, and at its own level and all above it lies in at most two bins of that
level's width.  Two intervals meet at the higher of their levels, in the bin in which the later one begins; so
the join is one of equal keys, levels and bins, followed by the exact test, whatever the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the width of a bin at the lowest level.
BASE_BITS = 4
Span = tuple[str, str]


def level_of(start: Column, end: Column) -> Column:
    """The lowest level whose bins are as wide as the interval of whole numbers ``start`` to ``end``, both within."""
    size = end - start
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)  # ceil(log2(size + 1))
    return F.greatest(F.lit(0), bits - BASE_BITS)


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("bigint"), level + BASE_BITS)


def _binned(rows: DataFrame, span: Span, top: int, prefix: str) -> DataFrame:
    """Each row in its bins at every level from its own to ``top``: ``__level, __bin`` and what the join needs."""
    start, end = (F.col(c).cast("bigint") for c in span)
    own = rows.where(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull() & (start <= end)).withColumn(f"__{prefix}own", level_of(start, end))
    levels = own.where(F.col(f"__{prefix}own") <= top).withColumn("__level", F.explode(F.sequence(F.col(f"__{prefix}own"), F.lit(top))))
    return levels.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin(start, F.col("__level")), _bin(end, F.col("__level"))))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: Span, right_span: Span, copies: int = 1) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose intervals (whole numbers, both ends within) overlap: the columns of both,
    ``keys`` once; other columns must differ in name.  A row with a null key or end, or whose end is before its
    start, has no pair.

    A bin with very many rows of ``left`` is split by Spark while it runs (skew of a merge join); with ``copies``
    its rows are dealt to as many groups, each of which gets all of ``right``'s rows of the bin.
    """
    # pairs meet at a level that one of the two has: no row needs a level above both sides' highest
    top = max((_top(x, s) for x, s in ((left, left_span), (right, right_span))), default=0)
    a, b = _binned(left, left_span, top, "l"), _binned(right, right_span, top, "r")
    a = a.withColumn("__copy", F.pmod(F.xxhash64(*left_span, *(c for c in left.columns if c not in keys)), F.lit(copies)).cast("int"))
    b = b.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "__level", "__bin", "__copy")]
    (s, e), (t, f) = ([F.col(f"{n}.{c}").cast("bigint") for c in span] for n, span in (("a", left_span), ("b", right_span)))
    level = F.col("a.__level")
    exact = [(F.col("__lown") == level) | (F.col("__rown") == level), s <= f, t <= e, _bin(F.greatest(s, t), level) == F.col("a.__bin")]
    joined = a.alias("a").join(b.alias("b").hint("merge"), [*same, *exact])
    return joined.select(*(F.col(f"a.{c}") for c in left.columns), *(F.col(f"b.{c}") for c in right.columns if c not in keys))


def _top(rows: DataFrame, span: Span) -> int:
    """The highest level of any interval: one number."""
    start, end = (F.col(c).cast("bigint") for c in span)
    return rows.where(start <= end).agg(F.max(level_of(start, end))).first()[0] or 0
