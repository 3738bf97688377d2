"""Freshness, pressure and budget arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col

STALE_BELOW = 40
MINUTE = 60_000


def _proof(now: str, mtime: Column, size: Column | None, ctime: Column, kind: str) -> tuple[Column, Column]:
    """Points and flag from comparing stored metadata with those of now (``now``: prefix of the
    columns ``<now>_mtime, <now>_size, <now>_ctime``)."""
    n_m, n_s, n_c = (F.col(f"{now}_{x}") for x in ("mtime", "size", "ctime"))
    same = n_m.eqNullSafe(mtime)
    if size is not None:
        same = same & n_s.eqNullSafe(size)
    both = n_c.isNotNull() & ctime.isNotNull()
    fine = same & both & (n_c == ctime)
    thing = "dir" if kind == "dir" else "file"
    flag = (
        F.when(~same, "dir changed" if kind == "dir" else "file modified")
        .when(fine, f"{thing} unchanged")
        .when(both, f"{thing} metadata changed")
        .otherwise(f"{thing} freshness unverified")
    )
    return F.when(fine, 40).otherwise(-60), flag


def confidence(workspace: str | None, now: Column, superseded: ColumnOrName | None = None) -> Column:
    """Struct ``score, flags, stale`` of a stored output, from 0 to 100.

    Reads the columns of the store's rows, and of snapshots joined to them: ``file_checked``
    with ``now_mtime, now_size, now_ctime``; ``dir_checked`` with ``dir_now_*``.  Checked with null
    metadata means deleted.  Unchanged needs equal time, size and change time of a file that was read
    or a folder that was listed, and equal time and change time for a command on a file.
    """
    c = F.col
    source, edited = c("source"), F.coalesce(c("edited_by_model"), F.lit(False))
    none = F.lit(None).cast("string")

    def result(points, flag) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(points).cast("int").alias("p"), lit(flag).cast("string").alias("f"))

    here = F.lit(workspace)
    own = c("workspace").isNotNull() & (c("workspace") != "") & F.lit(bool(workspace))
    place = F.when(~own, result(0, "no workspace")).when(c("workspace") == here, result(25, none)).otherwise(result(-70, "other workspace"))

    file_p, file_f = _proof("now", c("file_mtime"), c("file_size"), c("file_ctime"), "file")
    file_gone = c("now_mtime").isNull()
    model = F.when(edited, result(-60, "edited by model"))
    read = (
        F.when(~c("file_checked"), model.otherwise(result(0, "read_file (unverified)")))
        .when(file_gone, result(-60, "file deleted"))
        .when(c("file_mtime").isNotNull() & c("file_size").isNotNull(), result(file_p, file_f))
        .otherwise(model.otherwise(result(0, "read_file (unverified)")))
    )
    shell_p, shell_f = _proof("now", c("file_mtime"), None, c("file_ctime"), "file")
    shell = (
        F.when(file_gone, result(-60, "file deleted"))
        .when(c("file_mtime").isNotNull(), result(shell_p, shell_f))
        .otherwise(model.otherwise(result(0, "command (unverified)")))
    )
    dir_p, dir_f = _proof("dir_now", c("dir_mtime"), c("dir_size"), c("dir_ctime"), "dir")
    folder = (
        F.when(edited, result(-60, "edited by model"))
        .when(c("dir_now_mtime").isNull(), result(-60, "directory deleted"))
        .when(c("dir_mtime").isNotNull() & c("dir_size").isNotNull(), result(dir_p, dir_f))
        .otherwise(result(0, "command (unverified)"))
    )
    seen = F.coalesce(F.nullif(c("last_ref"), F.lit(0)), F.nullif(c("created_at"), F.lit(0)), now)
    since = now - seen
    web = result(F.when(since < 2 * MINUTE, 10).when(since < 15 * MINUTE, -15).otherwise(-35), "web result of a while ago")
    git = result(F.when(since < 5 * MINUTE, 5).when(since < 30 * MINUTE, -10).otherwise(-25), "git state of a while ago")
    other = (
        F.when(source.isin("web_search", "web_fetch"), web)
        .when((source == "shell_command") & c("command").rlike("^git (status|diff|log)"), git)
        .otherwise(result(0, "command (age only)"))
    )
    is_read = (source == "read_file") & c("file_path").isNotNull()
    is_shell = source == "shell_command"
    proof = (
        F.when(is_read, read)
        .when(is_shell & c("file_checked"), shell)
        .when(is_shell & c("dir_checked"), folder)
        .when(F.coalesce(source, F.lit("")).isin("", "read_file"), result(0, none))
        .otherwise(other)
    )
    proven = (
        (source.isin("read_file", "shell_command") & c("file_mtime").isNotNull())
        | (is_shell & c("dir_mtime").isNotNull() & c("dir_size").isNotNull())
    )
    age = now - F.coalesce(c("content_at"), c("created_at").cast("double"), now.cast("double"))
    aged = F.when(F.coalesce(proven, F.lit(False)), 0).when(age < 5 * MINUTE, 20).when(age < 60 * MINUTE, 5).when(age < 240 * MINUTE, -10).when(age < 1440 * MINUTE, -40).otherwise(-55)
    old = F.coalesce(col(superseded), F.lit(False)) if superseded is not None else F.lit(False)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + place["p"] + proof["p"] + aged + F.when(old, -30).otherwise(0))).cast("bigint")
    stale = score < STALE_BELOW
    flags = F.filter(F.array(place["f"], proof["f"], F.when(old, "superseded"), F.when(stale, "stale")), lambda f: f.isNotNull())
    return F.struct(score.alias("score"), flags.alias("flags"), stale.alias("stale"))


def stale_reason(flags: ColumnOrName) -> Column:
    """The most telling of a stale row's flags."""
    f = col(flags)
    out = None
    for flag in ("file deleted", "directory deleted", "file modified", "dir changed", "file metadata changed", "dir metadata changed", "edited by model", "superseded", "other workspace"):
        test = F.array_contains(f, flag)
        out = F.when(test, flag) if out is None else out.when(test, flag)
    return out.otherwise("too old")


def budget(tokens: ColumnOrName, limit: ColumnOrName, warn_at: float = 0.8) -> Column:
    """Struct ``total, headroom, headroom_pct, over_budget, warn`` against nine tenths of the limit."""
    t = col(tokens)
    inner = F.floor(col(limit) * 9 / 10)
    room = inner - t
    share = F.when(inner > 0, room / inner).otherwise(0.0)
    return F.struct(
        t.alias("total"), room.alias("headroom"), share.alias("headroom_pct"), (room < 0).alias("over_budget"),
        F.coalesce((inner > 0) & (room > 0) & (t / inner >= warn_at), F.lit(False)).alias("warn"),
    )


def pressure(growth: ColumnOrName, cache_ratio: ColumnOrName, turns: ColumnOrName) -> Column:
    """Struct ``score, level`` of context pressure."""
    g, r, t = col(growth), col(cache_ratio), col(turns)
    score = (
        F.when(g > 4000, 3).when(g > 1500, 1).otherwise(0)
        + F.when(r < 0.4, 3).when(r < 0.6, 1).otherwise(0)
        + F.when(t > 60, 2).when(t > 35, 1).otherwise(0)
    )
    level = F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")
    return F.struct(score.cast("bigint").alias("score"), level.alias("level"))


def pressure_tokens(window: ColumnOrName, share: float = 0.7, explicit: int = 150_000) -> Column:
    """Tokens from which old observations are masked."""
    return F.least(F.round(col(window) * share).cast("bigint"), F.lit(explicit).cast("bigint"))


def mask_allowed(context_tokens: ColumnOrName, least: ColumnOrName | int) -> Column:
    """Whether a context is large enough for old observations to be masked; 0 or less always is."""
    most = F.lit(least) if isinstance(least, int) else col(least)
    return (most <= 0) | (col(context_tokens) >= most)


def break_even(saved: ColumnOrName, overhead: ColumnOrName) -> Column:
    return col(saved) - col(overhead)


def relevance_of(counts: list[Column], terms: list[str]) -> Column:
    """:func:`relevance` without document frequencies, from the terms' counts."""
    import math

    raw = sum((F.least(n, F.lit(3)) * F.lit(1 + math.log1p(len(t) - 2)) for n, t in zip(counts, terms, strict=True)), F.lit(0.0))
    return F.least(F.lit(1.0), raw / F.lit(len(terms) * 3 * (1 + math.log1p(10))))


def relevance(folded: ColumnOrName, terms: list[str], idf: dict[str, float] | None = None) -> Column:
    """0 to 1: capped term frequency times inverse document frequency (or a weight by length) over
    its largest possible value."""
    if not terms:
        return F.lit(0.0)
    import math

    text, raw = col(folded), F.lit(0.0)
    for t in terms:
        n = ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("bigint")
        weight = idf.get(t, 0.0) if idf is not None else 1 + math.log1p(len(t) - 2)
        raw = raw + F.least(n, F.lit(3)) * F.lit(float(weight))
    most = len(terms) * 3 * (max([0.01, *(idf.get(t, 0.0) for t in terms)]) if idf is not None else 1 + math.log1p(10))
    return F.least(F.lit(1.0), raw / F.lit(most))
