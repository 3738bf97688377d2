"""Columns of any name: operators work on tables whose columns have plain names of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Plain:
    """``docs`` as ``df`` with columns ``in0``, ``in1``, ... by their place, so that no name of a caller
    meets one of an operator, in whatever case, and repeated names are told apart."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.columns = [f"in{i}" for i in range(len(self.names))]
        self.df = docs.toDF(*self.columns)

    def at(self, name: str) -> str:
        """The plain name of a column: the first that is called so, else so in another case."""
        found = [c for c, n in zip(self.columns, self.names, strict=True) if n == name] or [
            c for c, n in zip(self.columns, self.names, strict=True) if n.lower() == name.lower()
        ]
        if not found:
            raise ValueError(f"no column {name} in {self.names}")
        return found[0]

    def restored(self, out: DataFrame, changed: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
        """All columns under their own names, ``changed`` ones (by plain name) with new values, and the
        ``added`` ones; columns that are called like an added one are replaced."""
        changed, added = changed or {}, added or {}
        new = {n.lower() for n in added}
        kept = [(c, n) for c, n in zip(self.columns, self.names, strict=True) if n.lower() not in new]
        return out.select(*(changed.get(c, F.col(c)).alias(c) for c, _ in kept), *(x.alias(f"out{i}") for i, x in enumerate(added.values()))).toDF(*(n for _, n in kept), *added)
