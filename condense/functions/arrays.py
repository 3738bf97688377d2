"""Grouping and cutting within one array, in time n log n."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let


def run_starts(a: Column, same: Callable[[Column, Column], Column]) -> Column:
    """0-based places where a run of equal neighbours begins."""
    return F.filter(F.transform(a, lambda x, i: F.when(i == 0, i).when(~same(x, F.try_element_at(a, i)), i)), lambda i: i.isNotNull())


def count_by_first(keys: Column) -> Column:
    """Structs ``first, key, n`` of the distinct keys in the order of their first place (0-based)."""

    def grouped(s: Column) -> Column:
        starts = run_starts(s, lambda x, y: x["key"] == y["key"])
        return let(starts, lambda at: F.array_sort(F.transform(at, lambda p, j: F.struct(
            F.element_at(s, p + 1)["i"].alias("first"), F.element_at(s, p + 1)["key"].alias("key"),
            (F.coalesce(F.try_element_at(at, j + 2), F.size(s)) - p).alias("n")))))

    return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i")))), grouped)


def prefix_within(sizes: Column, budget: Column) -> Column:
    """How many elements are taken until their sum reaches the budget: the one that crosses it counts."""
    fold = F.aggregate(
        sizes, F.struct(budget.cast("bigint").alias("left"), F.lit(0).alias("n")),
        lambda s, x: F.when(s["left"] > 0, F.struct((s["left"] - x).alias("left"), (s["n"] + 1).alias("n"))).otherwise(s),
    )
    return fold["n"]


def coverage_size(items: Column, shingles: Callable[[Column], Column], least: Column, most: Column, gain: float = 0.03) -> Column:
    """How many items, longest first, are worth keeping: up to the last that adds at least ``gain``
    of all distinct shingles."""
    longest = F.array_sort(F.transform(items, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    pairs = F.flatten(F.transform(longest, lambda s, at: F.transform(shingles(s["x"]), lambda g: F.struct(g.alias("g"), at.alias("at")))))

    def size(p: Column) -> Column:
        firsts = F.transform(run_starts(p, lambda x, y: x["g"] == y["g"]), lambda k: F.element_at(p, k + 1)["at"])

        def elbow(f: Column) -> Column:
            worthy = F.filter(count_by_first(f), lambda r: (r["key"] > 0) & (r["n"] >= gain * F.size(f)))
            last = F.coalesce(F.array_max(F.transform(worthy, lambda r: r["key"])), F.lit(0))
            return F.when(F.size(f) == 0, F.size(items)).otherwise(F.least(F.size(items), F.least(most, F.greatest(least, last + 1))))

        return let(firsts, elbow)

    return let(F.array_sort(pairs), size)
