"""Recall and symbols as SQL table functions over a table argument.

``SELECT * FROM recall(TABLE(store) PARTITION BY workspace ORDER BY (last_ref DESC), 'words', 10)``: Spark deals the table
out and sorts each partition; a function walks through it and holds no more than what it gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.pyudf import symbol_of

#: Characters of a text around the place where it is found.
SNIPPET_CHARS = 2000


def _checked(table: AnalyzeArgument, needed: tuple[str, ...], function: str) -> list[str]:
    """The names of the argument's columns, which must be a table with those that are needed."""
    if not table.isTable:
        raise ValueError(f"the first argument of {function} must be TABLE(...)")
    names = [f.name for f in table.dataType.fields]
    missing = [n for n in needed if n not in names]
    if missing:
        raise ValueError(f"{function} needs columns {', '.join(needed)}; {', '.join(missing)} missing")
    return names


class Recall:
    """The first ``limit`` rows, in the order that is asked for, whose ``content`` has one of the query's words or, for a single word,
    matches it as a pattern (as text where it is none)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _checked(rows, ("hash", "content"), "recall")
        if not isinstance(query.value, str) or not isinstance(limit.value, int) or limit.value < 0:
            raise ValueError("recall needs a constant query and a constant limit of 0 or more")
        return AnalyzeResult(StructType().add("hash", "string").add("rank", "integer").add("at", "integer").add("snippet", "string"))

    def __init__(self):
        self.given, self.find = 0, None

    def _finder(self, query: str):
        words = query[:512].lower().split()
        if len(words) > 1:
            return lambda t: next((t.lower().find(w) for w in words if w in t.lower()), -1)
        try:
            pattern = re.compile(query[:512], re.I)
        except re.error:
            pattern = re.compile(re.escape(query[:512]), re.I)
        return lambda t: -1 if not words or (m := pattern.search(t)) is None else m.start()

    def eval(self, row, query: str, limit: int) -> Iterator[tuple]:
        if self.given >= limit or row["content"] is None:
            return
        self.find = self.find or self._finder(query)
        at = self.find(row["content"])
        if at >= 0:
            self.given += 1
            text = row["content"]
            start = max(0, min(at - SNIPPET_CHARS // 2, len(text) - SNIPPET_CHARS))
            yield row["hash"], self.given, at + 1, text[start:start + SNIPPET_CHARS]


class Symbol:
    """The definitions of a name in ``content``, as :func:`condense.functions.pyudf.symbol_of` cuts them out, at most ``limit``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, name: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _checked(rows, ("hash", "content"), "symbol")
        return AnalyzeResult(StructType().add("hash", "string").add("definition", "string"))

    def __init__(self):
        self.given = 0

    def eval(self, row, name: str, limit: int) -> Iterator[tuple]:
        if self.given < limit and (found := symbol_of(row["content"], name)) is not None:
            self.given += 1
            yield row["hash"], found

    def terminate(self) -> Iterator[tuple]:
        return iter(())


def register(spark: SparkSession) -> None:
    """Make ``recall`` and ``symbol`` known to a session's SQL."""
    spark.udtf.register("recall", udtf(Recall))
    spark.udtf.register("symbol", udtf(Symbol))
