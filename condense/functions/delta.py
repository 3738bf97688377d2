"""Hunks, summaries and patches of edit scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col, let
from .text import count_lines

CONTEXT = 2


def summary(script: ColumnOrName, old: ColumnOrName, new: ColumnOrName) -> Column:
    """Struct ``added, removed, changed_ratio`` over the longer text's lines."""
    s = col(script)
    n = lambda k: F.size(F.filter(s, lambda r: r["kind"] == k)).cast("bigint")
    longest = F.greatest(count_lines(old), count_lines(new), F.lit(1))
    return F.when(s.isNotNull(), let(F.struct(n("add").alias("a"), n("del").alias("d")), lambda x: F.struct(x["a"].alias("added"), x["d"].alias("removed"), ((x["a"] + x["d"]) / longest).alias("changed_ratio"))))


def hunks(script: ColumnOrName, context: int = CONTEXT) -> Column:
    """Groups of changes with context lines around them; groups that would touch are one.  Structs
    ``old_start, old_lines, new_start, new_lines, lines``."""
    s = col(script)
    changed = F.filter(F.transform(s, lambda r, i: F.when(r["kind"] != "same", i)), lambda i: i.isNotNull())

    def group(c: Column) -> Column:
        heads = F.filter(F.transform(c, lambda i, k: F.when((k == 0) | (i - F.try_element_at(c, k) > 2 * context + 1), k)), lambda k: k.isNotNull())

        def cut(h: Column) -> Column:
            def one(k: Column, g: Column) -> Column:
                first = F.greatest(F.lit(0), F.element_at(c, k + 1) - context)
                last = F.least(F.size(s) - 1, F.element_at(c, F.coalesce(F.try_element_at(h, g + 2), F.size(c))) + context)
                own = F.slice(s, first + 1, last - first + 1)

                def describe(o: Column) -> Column:
                    olds, news = F.filter(o, lambda r: r["old_line"] > 0), F.filter(o, lambda r: r["new_line"] > 0)
                    return F.struct(
                        F.coalesce(F.try_element_at(olds, F.lit(1))["old_line"], F.lit(0)).alias("old_start"), F.size(olds).alias("old_lines"),
                        F.coalesce(F.try_element_at(news, F.lit(1))["new_line"], F.lit(0)).alias("new_start"), F.size(news).alias("new_lines"),
                        F.transform(o, lambda r: F.concat(F.when(r["kind"] == "add", "+").when(r["kind"] == "del", "-").otherwise(" "), r["line"])).alias("lines"),
                    )

                return let(own, describe)

            return F.transform(h, one)

        return let(heads, cut)

    return let(changed, group)


def patch(hunks_: ColumnOrName, unchanged: ColumnOrName | None = None) -> Column:
    """Patch text of hunks, with a note of how many lines did not change."""
    h = col(hunks_)
    head = lambda x: F.format_string("@@ -%d,%d +%d,%d @@", x["old_start"], x["old_lines"], x["new_start"], x["new_lines"])
    body = F.array_join(F.transform(h, lambda x: F.concat(head(x), F.lit("\n"), F.array_join(x["lines"], "\n"))), "\n")
    return body if unchanged is None else F.concat(body, F.lit("\n["), col(unchanged).cast("string"), F.lit(" unchanged lines]"))


def window_shift(hunks_: ColumnOrName, first: ColumnOrName, last: ColumnOrName) -> Column:
    """Struct ``changed, shift``: whether a hunk overlaps a window of old lines, and by how many lines
    the hunks before move it."""
    h, a, b = col(hunks_), col(first), col(last)
    over = F.exists(h, lambda x: (x["old_start"] <= b) & (x["old_start"] + F.greatest(x["old_lines"], F.lit(1)) - 1 >= a))
    before = F.filter(h, lambda x: x["old_start"] + F.greatest(x["old_lines"], F.lit(1)) - 1 < a)
    return F.struct(over.alias("changed"), F.aggregate(before, F.lit(0), lambda s, x: s + x["new_lines"] - x["old_lines"]).alias("shift"))


def window_delta(hunks_: ColumnOrName, path: ColumnOrName, offset: ColumnOrName, limit: ColumnOrName, new_lines: ColumnOrName, old_lines: ColumnOrName,
                 ref: ColumnOrName | None = None) -> Column:
    """Struct ``text, kind`` of what changed inside a window of lines of the new text: ``changed`` with the
    hunks that overlap it, or ``unchanged`` with the lines of the old text that it equals.  Null for a
    window outside the text, or one that the old text does not have."""
    h, p, first, total, before = col(hunks_), col(path), col(offset), col(new_lines), col(old_lines)
    end = F.least(first + col(limit) - 1, total)
    store = F.concat(F.lit("full text in store"), F.coalesce(F.concat(F.lit(" "), col(ref)), F.lit("")) if ref is not None else F.lit(""))
    last = lambda x: x["new_start"] + F.greatest(x["new_lines"], F.lit(1)) - 1

    def render(i: Column) -> Column:
        head = F.format_string("[Changes in %s: lines %d-%d of %d, %d change block(s) inside]", p, first, end, total, F.size(i))
        shift = F.aggregate(F.filter(h, lambda x: last(x) < first), F.lit(0), lambda s, x: s + x["new_lines"] - x["old_lines"])

        def same(moved: Column) -> Column:
            where = F.when(moved == 0, "identical to the same lines you already read").otherwise(
                F.format_string("identical to lines %d-%d of the version you already have (moved by %d)", first - moved, end - moved, moved)
            )
            note = F.when(F.size(h) > 0, F.concat(F.format_string("%d change block(s) elsewhere; ", F.size(h)), store)).otherwise(store)
            body = F.concat(head, F.format_string("\n  [%d lines unchanged, %s]\n  [%s]", end - first + 1, where, note))
            return F.when((first - moved >= 1) & (end - moved <= before), F.struct(body.alias("text"), F.lit("unchanged").alias("kind")))

        gap = lambda n: F.format_string("  [%d unchanged lines]", n)

        def add(s: Column, x: Column) -> Column:
            skipped = F.when(x["new_start"] > s["pos"], F.array(gap(x["new_start"] - s["pos"]))).otherwise(F.array().cast("array<string>"))
            hunk = F.concat(F.array(F.format_string("@@ -%d,%d +%d,%d @@", x["old_start"], x["old_lines"], x["new_start"], x["new_lines"])), x["lines"])
            left = s["same"] + F.greatest(x["new_start"] - s["pos"], F.lit(0))
            return F.struct(F.greatest(s["pos"], last(x) + 1).cast("int").alias("pos"), left.cast("int").alias("same"), F.concat(s["out"], skipped, hunk).alias("out"))

        def close(s: Column) -> Column:
            rest = F.greatest(end - s["pos"] + 1, F.lit(0))
            tail = F.when(rest > 0, F.array(gap(rest))).otherwise(F.array().cast("array<string>"))
            note = F.format_string("  [%d of the %d requested lines unchanged; %d change block(s) elsewhere; %s]", s["same"] + rest, end - first + 1, F.size(h) - F.size(i), store)
            return F.struct(F.array_join(F.concat(F.array(head), s["out"], tail, F.array(note)), "\n").alias("text"), F.lit("changed").alias("kind"))

        start = F.struct(first.cast("int").alias("pos"), F.lit(0).alias("same"), F.array().cast("array<string>").alias("out"))
        return F.when(F.size(i) > 0, F.aggregate(i, start, add, close)).otherwise(let(shift, same))

    inside = F.filter(h, lambda x: (last(x) >= first) & (x["new_start"] <= end))
    return F.when((first >= 1) & (col(limit) >= 1) & (total >= 1) & (first <= total), let(inside, render))
