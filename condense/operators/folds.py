"""Folds over the rows of each key in order, with a small state.

Rows are dealt by key, sorted within partitions (on disk where they do not fit) and streamed, so a key
of any number of rows takes the memory of one Arrow batch and one state.  A key's rows follow one
another, so a hot key is one task; its rows are never gathered.  Values keep their own types, so nulls
and 64-bit numbers are exact.  Where what a block of rows does to a state can be written down,
:mod:`condense.operators.scan` spreads a hot key too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import arrow_types

_SAME = object()


def fold(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]],
         schema: str, end: Callable[[Any], tuple | None] | None = None) -> DataFrame:
    """``key`` and the values of ``schema``: what ``step(state, values of columns)`` gives beside the next
    state, none where that is null, and what ``end(state)`` gives when a key's rows are over.  Equal
    orders are told apart by all ``columns``."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(f.strip().split(" ")[0] for f in schema.split(","))]

    kinds: list = []
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = _SAME, None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [kinds[0], *types], strict=True)], names)

        for batch in batches:
            kinds[:] = [batch.schema.field(0).type]
            for own, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is _SAME or own != now:
                    if now is not _SAME and end is not None and (last := end(state)) is not None:
                        out.append((now, *last))
                    now, state = own, start()
                state, given = step(state, tuple(values))
                if given is not None:
                    out.append((now, *given))
            if out:
                yield made(out)
                out = []
        if now is not _SAME and end is not None and (last := end(state)) is not None:
            yield made([(now, *last)])

    dealt = rows.select(key, *(F.col(c) for c in columns), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order))).repartition(key)
    places = [f"__o{i}" for i in range(len(order))]
    return dealt.sortWithinPartitions(key, *places, *columns).drop(*places).mapInArrow(run, f"`{key}` {kind}, {schema}")
