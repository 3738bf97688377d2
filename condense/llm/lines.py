"""Removal of repeated runs of lines by winnowing, with DataFrame operations only.

Of ``RUN`` consecutive line hashes, the hash of every pair (or longer gram) is taken and each
window of grams keeps its least one as fingerprint, so any run of ``RUN`` equal lines shares one.
Fingerprints are counted and joined with their positions; only those of repeated ones go on, with
the line hashes around them, and are extended both ways to the (at most two) runs of ``RUN`` lines
that hold them.  The first place of each run stays; at all later ones its lines go.  So no two
positions are paired, however many share a fingerprint, and a longer repeat is the union of its runs.

Where ``least_words`` is given, shorter runs (down to one line) that hold so many words count too.
Every one of them is its own fingerprint, whatever its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from .columns import Plain
from ..sources.scratch import drop_stored, stored

#: Lines of the shortest run that counts as repeated.
RUN = 3

#: Words of a shorter run that counts as repeated where runs are measured by content too.
LEAST_WORDS = 8


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each ``k`` neighbours."""
    n = F.size(hashes) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(*(F.element_at(hashes, i + j) for j in range(k)))))


def _fingerprints(grams: Column, width: int) -> Column:
    """0-based positions of the least gram (the first of equals) of each ``width`` neighbours."""
    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    n = F.size(grams) - (width - 1)
    least = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda s: F.array_min(F.slice(pairs, s, width)).getField("i"))
    return F.when(n > 0, F.array_distinct(least))


def line_words(text: Column) -> Column:
    """Words of each line, cut at white space."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_count(x, F.lit(r"\S+")))


def _rich_runs(docs: DataFrame, n: int, least_words: int) -> DataFrame:
    """From ``key, hashes, words``: ``key, start, n, a, b`` of every run of ``n`` lines that holds at
    least ``least_words`` words."""
    starts = F.sequence(F.lit(0), F.size("hashes") - n)
    rich = F.filter(starts, lambda o: F.aggregate(F.slice("words", o + 1, n), F.lit(0), lambda x, y: x + y) >= least_words)
    own = docs.where(F.size("hashes") >= n).select("key", F.explode(F.transform(rich, lambda o: F.struct(o.alias("start"), F.slice("hashes", o + 1, n).alias("lines")))).alias("w"))
    return own.select("key", F.col("w.start").alias("start"), F.lit(n).alias("n"), F.xxhash64("w.lines").alias("a"), F.hash("w.lines").alias("b"))


def repeated_runs(docs: DataFrame, run: int = RUN, least_words: int | None = None) -> DataFrame:
    """From ``key, hashes array<bigint>`` (and ``words array<int>`` with ``least_words``): ``key, runs
    array<struct<start int, n int>>``, the 0-based starts and the lines of all runs of ``run`` lines, and
    of shorter ones with ``least_words`` words, that also start earlier (smaller key, or same key and
    smaller start)."""
    k = (run + 1) // 2
    width = run - k + 1
    grams = docs.where(F.size("hashes") >= run).select("key", "hashes", _grams(F.col("hashes"), k).alias("grams"))
    at = grams.select("key", "hashes", "grams", F.explode(_fingerprints(F.col("grams"), width)).alias("p"))
    # the lines that any run with this fingerprint can have, and where they begin
    first = F.greatest(F.lit(0), F.col("p") - (width - 1))
    places = at.select(
        "key", "p", F.element_at("grams", F.col("p") + 1).alias("fingerprint"), first.alias("first"),
        F.slice("hashes", first + 1, F.col("p") + run - first).alias("around"),
    )
    places = stored(places, "lines-places")
    counted = stored(places.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "lines-fingerprints")
    # both sides are read from written tables, so that Spark can split a hot fingerprint; all joins
    # here are merges whatever the sizes, so the plan is the same for small and large inputs
    joined = places.hint("merge").join(counted, "fingerprint")
    n = F.least(F.lit(width), F.size("around") - (run - 1))
    extended = joined.where(F.size("around") >= run).select(
        "key", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct((F.col("first") + o).alias("start"), F.slice("around", o + 1, run).alias("lines")))).alias("w")
    )
    windows = extended.select("key", F.col("w.start").alias("start"), F.lit(run).alias("n"), F.xxhash64("w.lines").alias("a"), F.hash("w.lines").alias("b"))
    for n in range(1, run) if least_words is not None else ():
        windows = windows.unionByName(_rich_runs(docs, n, least_words))
    windows = stored(windows.distinct(), "lines-runs")
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("key", "start")).alias("one"), F.count("*").alias("times")).where("times > 1").drop("times")
    firsts = stored(firsts, "lines-firsts")
    drop_stored(places, counted)
    later = windows.hint("merge").join(firsts, ["a", "b"]).where(F.struct("key", "start") > F.col("one"))
    return later.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int | None = None) -> DataFrame:
    """Remove every line in a run of ``run`` lines that also starts earlier: in a document with a
    smaller id, or in the same document before.  Lines are cut at newlines and compared whole.
    With ``least_words``, lines in shorter runs that hold at least so many words go alike.

    Returns the columns of ``docs``, the text without those lines, and ``n_lines bigint,
    n_removed bigint``.  Runs are judged on the input.  A null text stays null and has no lines; an
    empty text is one empty line; documents of fewer than ``run`` lines lose none without ``least_words``; rows that repeat
    id and text are one document and fare alike; texts of one id are ordered by a hash; a
    null id comes first; an empty table gives no rows.  Columns of ``docs`` with the names of the new
    ones are replaced; all others, whatever their names, stay.
    """
    plain = Plain(docs)
    docs, key_id, text = plain.df, plain.at(id_col), plain.at(text_col)
    key = F.struct(F.col(key_id).alias("id"), F.xxhash64(text).alias("text"))
    words = () if least_words is None else (line_words(F.col(text)).alias("words"),)
    keyed = docs.where(F.col(text).isNotNull()).select(key.alias("key"), line_hashes(F.col(text)).alias("hashes"), *words)
    gone = repeated_runs(keyed, run, least_words).select(F.col("key.id").alias("gone_id"), F.col("key.text").alias("gone_text"), "runs")
    gone = stored(gone, "lines-gone")
    same = F.col(key_id).eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_text"))
    joined = docs.withColumn("hash", F.xxhash64(text)).hint("merge").join(gone, same, "left")
    lines = F.split(F.col(text), "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    kept = F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.array_join(_without(lines, covered), "\n"))
    return plain.restored(joined, {text: kept}, {
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
        "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("bigint"),
    })


def _without(lines: Column, covered: Column) -> Column:
    """The lines whose 0-based place is not in ``covered``."""
    kept = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), covered)
    return let(lines, lambda x: F.transform(kept(x), lambda i: F.element_at(x, i + 1)))
