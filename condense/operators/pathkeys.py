"""Many path terms at once against an index of paths.

A term finds the key that it is; failing that, keys that end with it, or whose last segment has it inside.  What a term
may begin is indexed: keys from back to front, and every ending of a last segment.  Terms and entries meet on equal
beginnings, as long as a power of two that the term is not shorter than, so that a term meets
entries that share at least half of it, and no key is held against all terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(index: DataFrame) -> DataFrame:
    """From postings (``term, id``), ``side, entry, key``: each distinct key reversed (``end``) and the endings of its last
    segment (``inside``).  A key of n characters has at most n + 1 entries."""
    keys = index.select(F.col("term").alias("key")).where(F.col("key") != "").distinct()
    last = F.element_at(F.split("key", "/"), -1)
    back = keys.select(F.lit("end").alias("side"), F.reverse("key").alias("entry"), "key")
    starts = F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1)))
    inside = keys.where(F.length(last) > 0).select(F.lit("inside").alias("side"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(last, i, F.length(last))))).alias("entry"), "key")
    return back.unionByName(inside)


def _width(term: Column) -> Column:
    """The largest power of two that is no more than a term's length."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.length(term).cast("bigint"))) - 1)


def lookup(index: DataFrame, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``lookup, id`` for each of ``terms`` (``lookup``) and each document with a key that it finds, as
    :func:`search.path_lookup` finds them for one term.  ``held``: :func:`entries` of the index, kept in a table."""
    own = terms.select("lookup", F.trim(F.lower("lookup")).alias("t")).where(F.col("t") != "").distinct()
    held = held if held is not None else entries(index)
    exact = own.join(index.select(F.col("term").alias("key")).distinct(), F.col("t") == F.col("key")).select("lookup", "key")
    open_ = own.join(exact.select("lookup").distinct(), "lookup", "left_anti")
    asked = open_.select("lookup", "t", F.explode(F.array(F.struct(F.lit("end").alias("side"), F.reverse("t").alias("x")), F.struct(F.lit("inside").alias("side"), F.col("t").alias("x")))).alias("a"))
    asked = asked.select("lookup", "a.side", "a.x", _width(F.col("a.x")).alias("width")).withColumn("begins", F.substring(F.col("x"), F.lit(1), F.col("width")))
    # only widths that some term has: a number a power of two, of which there are few
    widths = [r.width for r in asked.select("width").distinct().collect()]
    if not widths:
        widths = [1]
    fits = F.filter(F.array(*map(F.lit, sorted(widths))), lambda w: w <= F.length("entry"))
    offered = held.select("side", "entry", "key", F.explode(fits).alias("width")).withColumn("begins", F.substring(F.col("entry"), F.lit(1), F.col("width")))
    met = asked.join(offered, ["side", "width", "begins"]).where(F.col("entry").startswith(F.col("x")) & (F.length("key") > F.length("x")))
    found = exact.unionByName(met.select("lookup", "key").distinct())
    return found.join(index.select(F.col("term").alias("key"), "id"), "key").select("lookup", "id").distinct()
