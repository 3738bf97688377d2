"""Re-serving stored outputs: freshness against file snapshots, deltas, windows, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import commands, delta, scores, text
from ..functions.pyudf import line_diff
from . import scan, store

RATIO, OVERHEAD, RECALL_CHARS, FIDELITY_CHARS = 0.4, 260, 2000, 24 * 1024


def with_snapshot(blobs: DataFrame, snapshot: DataFrame, folders: DataFrame | None = None, path: str = "file_path") -> DataFrame:
    """Metadata of now beside each row: ``file_checked`` with ``now_mtime, now_size, now_ctime``, and for
    commands on a folder (rows with ``dir_mtime``) ``dir_checked`` with ``dir_now_*`` from ``folders``
    (:func:`condense.sources.blobs.folder_signature`).  A path that a snapshot lacks is deleted;
    rows without a path are unchecked, and so are folders where no ``folders`` are given."""
    kinds = ("mtime", "size", "ctime")
    on_folder = F.col("dir_mtime").isNotNull() & (F.col("source") == "shell_command") if {"dir_mtime", "source"} <= set(blobs.columns) else F.lit(False)
    s = snapshot.select(F.col("path").alias("__p"), *(F.col(c).alias(f"now_{c}") for c in kinds))
    rows = blobs.withColumn("file_checked", F.col(path).isNotNull() & ~F.coalesce(on_folder, F.lit(False)))
    rows = rows.join(s, F.col("file_checked") & (F.col(path) == F.col("__p")), "left").drop("__p")
    if folders is None:
        for c in kinds:
            rows = rows.withColumn(f"dir_now_{c}", F.lit(None).cast("double"))
        return rows.withColumn("dir_checked", F.lit(False))
    d = folders.select(F.col("path").alias("__p"), *(F.col(c).cast("double").alias(f"dir_now_{c}") for c in kinds))
    rows = rows.withColumn("dir_checked", F.col(path).isNotNull() & F.coalesce(on_folder, F.lit(False)))
    return rows.join(d, F.col("dir_checked") & (F.col(path) == F.col("__p")), "left").drop("__p")


def score(blobs: DataFrame, snapshot: DataFrame, now: Column, workspace: str | None = None, folders: DataFrame | None = None) -> DataFrame:
    """``blobs`` with ``score, flags, stale``."""
    rows = with_snapshot(store.newest_per_command(blobs), snapshot, folders)
    return rows.withColumn("c", scores.confidence(workspace, now, "supplanted")).select(*blobs.columns, "c.score", "c.flags", "c.stale")


def unchanged() -> Column:
    """Strict proof: time, size and change time of now equal those stored."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return same("now_mtime", "file_mtime") & same("now_size", "file_size") & same("now_ctime", "file_ctime")


def tool_hits(calls: DataFrame, blobs: DataFrame, snapshot: DataFrame, never: list[str] | None = None) -> DataFrame:
    """For each call (``call_id, tool, command, path, pattern``): ``decision`` of ``serve, delta, run`` with a
    reason and the stored row's hash.  Calls with side effects run; windows of full files come last
    among candidates."""
    c = calls.withColumn("__key", commands.match_key("tool", "command", "path"))
    b = blobs.withColumn("__key", commands.match_key("source", "command", "file_path")).select(
        "__key", F.col("source").alias("tool"), F.coalesce("search_pattern", F.lit("")).alias("__pattern"),
        F.struct((~F.coalesce(F.col("full_file"), F.lit(False))).cast("int").alias("part"), "last_ref", "created_at", "seq", "hash", "file_path", "file_mtime", "file_size", "file_ctime").alias("r"),
    )
    best = b.groupBy("__key", "tool", "__pattern").agg(F.max("r").alias("r"))
    c = c.withColumn("__pattern", F.coalesce("pattern", F.lit("")))
    joined = c.join(best, ["__key", "tool", "__pattern"], "left")
    s = snapshot.select(F.col("path").alias("__p"), *(F.col(x).alias(f"now_{x}") for x in ("mtime", "size", "ctime")))
    joined = joined.join(s, F.col("r.file_path") == F.col("__p"), "left")
    for x in ("mtime", "size", "ctime"):
        joined = joined.withColumn(f"file_{x}", F.col(f"r.file_{x}"))
    shell = F.col("tool") == "shell_command"
    effect = shell & (commands.is_side_effect("command") | (commands.never_elided("command", never) if never else F.lit(False)))
    reason = (
        F.when(effect, "side effect").when(F.col("r").isNull(), "not stored").when(F.col("r.file_path").isNull(), "no proof")
        .when(F.col("now_mtime").isNull(), "file deleted").when(unchanged(), "unchanged").otherwise("file modified")
    )
    decision = F.when(reason == "unchanged", "serve").when(reason == "file modified", "delta").otherwise("run")
    return joined.select(*calls.columns, F.col("r.hash").alias("hash"), reason.alias("reason"), decision.alias("decision"))


def deltas(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with ``script, added, removed, changed_ratio, hunks, patch``; all null where the middle is too
    long.  Equal texts do not reach Python."""
    same = pairs.where(F.col(old).eqNullSafe(F.col(new))).withColumn("script", F.array().cast("array<struct<kind:string,line:string,old_line:int,new_line:int>>"))
    other = pairs.where(~F.col(old).eqNullSafe(F.col(new))).withColumn("script", line_diff(F.col(old), F.col(new)))
    full = same.unionByName(other).withColumn("__s", delta.summary("script", old, new)).withColumn("hunks", delta.hunks("script"))
    return full.select(*pairs.columns, "script", "__s.added", "__s.removed", "__s.changed_ratio", "hunks", delta.patch("hunks").alias("patch"))


def delta_decisions(pairs: DataFrame, safe: Column | None = None, cap: int = FIDELITY_CHARS) -> DataFrame:
    """``pairs`` (``old, new``) with ``decision`` of ``identical, delta, full`` and the reason for a refusal."""
    d = deltas(pairs)
    safe = safe if safe is not None else F.lit(True)
    reason = (
        F.when(F.col("old").isNull(), "no prior").when(~safe, "not in context").when(F.col("script").isNull(), "too long")
        .when(F.col("changed_ratio") > RATIO, "too different").when(F.length("patch") >= F.length("new"), "patch not shorter")
        .when(F.length("patch") > cap - OVERHEAD, "patch over budget")
    )
    same = F.col("old").eqNullSafe(F.col("new")) & F.col("old").isNotNull()
    decision = F.when(reason.isNotNull(), "full").when(same, "identical").otherwise("delta")
    return d.select(*pairs.columns, "added", "removed", "changed_ratio", decision.alias("decision"), reason.alias("reason"), F.when(decision == "delta", F.col("patch")).alias("patch"))


def reread_deltas(reads: DataFrame, blobs: DataFrame, safe: DataFrame | None = None, prior: int = 5, cap: int = FIDELITY_CHARS) -> DataFrame:
    """``reads`` (``read_id, path, content``) with ``decision`` of ``delta, full``, the patch against the first of
    the path's ``prior`` latest stored versions that gives one, its hash, and the reason if none does.

    ``safe``: hashes that are still in the context (null: all are).  A version that is not in it, or
    equals the text, or differs too much, or whose patch is not shorter, is passed over; the reasons
    come in that order of weight."""
    stored_ = store.prior_versions(blobs.where("source = 'read_file' and content is not null"), prior)
    v = stored_.select(F.col("file_path").alias("path"), "hash", "place", text.strip_line_numbers(F.col("content")).alias("old"))
    if safe is not None:
        v = v.join(safe.select("hash").distinct().withColumn("__safe", F.lit(True)), "hash", "left").withColumn("__safe", F.coalesce("__safe", F.lit(False)))
    else:
        v = v.withColumn("__safe", F.lit(True))
    pairs = reads.select("read_id", "path", text.strip_line_numbers(F.col("content")).alias("new")).join(v, "path")
    d = deltas(pairs.withColumn("old", F.when(F.col("__safe"), F.col("old"))).where("__safe")).unionByName(pairs.where("not __safe"), allowMissingColumns=True)
    why = (
        F.when(~F.col("__safe"), "not in context").when(F.col("old") == F.col("new"), "identical").when(F.col("script").isNull(), "too long")
        .when(F.col("changed_ratio") > RATIO, "too different").when((F.length("patch") >= F.length("new")) | (F.length("patch") > cap - OVERHEAD), "patch not shorter")
    )
    weight = F.array_position(F.array(*map(F.lit, ("identical", "patch not shorter", "too long", "too different", "not in context"))), why)
    tried = d.withColumn("why", why).groupBy("read_id").agg(
        F.min_by(F.when(F.col("why").isNull(), F.struct("hash", "patch")), F.when(F.col("why").isNull(), F.col("place"))).alias("best"), F.max_by("why", weight).alias("why")
    )
    joined = reads.join(tried, "read_id", "left")
    served = F.col("best").isNotNull()
    reason = F.when(~served, F.coalesce("why", F.lit("no prior")))
    return joined.select(*reads.columns, F.when(served, "delta").otherwise("full").alias("decision"), reason.alias("reason"), F.col("best.hash").alias("hash"), F.col("best.patch").alias("patch"))


def refusals(decisions: DataFrame) -> DataFrame:
    """``reason, n``: how often each reason has kept a delta from being served (null: served)."""
    return decisions.groupBy("reason").agg(F.count("*").alias("n"))


def window_deltas(requests: DataFrame, blobs: DataFrame, files: DataFrame, safe: DataFrame | None = None, cap: int = FIDELITY_CHARS) -> DataFrame:
    """Changes inside line windows (``path, offset, limit``) of files that were read in full before.

    ``blobs``: stored versions; ``files``: texts of now (``path, content``); ``safe``: hashes still in the
    context (null: all).  Adds ``kind`` and ``text`` of the window's changes, or ``reason``."""
    full = store.best_version(blobs.where("full_file and content is not null"), "file_path").select(F.col("file_path").alias("path"), "hash", F.col("content").alias("old"))
    if safe is not None:
        full = full.join(safe.select("hash").distinct().withColumn("__safe", F.lit(True)), "hash", "left")
    else:
        full = full.withColumn("__safe", F.lit(True))
    wanted = requests.select("path").distinct()
    pairs = wanted.join(full, "path").join(files.select("path", F.col("content").alias("new")), "path")
    d = deltas(pairs).select("path", "hash", "__safe", "old", "new", "script", "added", "removed", "changed_ratio", "hunks")
    joined = requests.join(d, "path", "left")
    ref = F.concat(F.lit("[blob:"), F.left("hash", F.lit(12)), F.lit("]"))
    made = delta.window_delta("hunks", "path", F.col("offset"), F.col("limit"), text.count_lines("new"), text.count_lines("old"), ref)
    joined = joined.withColumn("__w", made).withColumn("__slice", text.line_window("new", F.col("offset"), F.col("limit")))
    size = F.length("__w.text")
    reason = (
        F.when(F.col("hash").isNull(), "no prior").when(~F.coalesce("__safe", F.lit(False)), "not in context").when(F.col("script").isNull(), "too long")
        .when(F.col("added") + F.col("removed") == 0, "identical").when(F.col("changed_ratio") > RATIO, "too different")
        .when(F.col("__w").isNull() | F.col("__slice").isNull(), "out of bounds").when((size + OVERHEAD >= F.length("__slice")) | (size > cap - OVERHEAD), "patch not shorter")
    )
    fine = reason.isNull()
    return joined.select(*requests.columns, F.when(fine, F.col("__w.kind")).alias("kind"), F.when(fine, F.col("__w.text")).alias("text"), reason.alias("reason"))


def windows(requests: DataFrame, blobs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Serve line windows (``path, offset, limit``) from the newest full version of a file that is proven
    unchanged.  ``window`` or ``reason``: ``no-blob, stale, out-of-bounds``."""
    full = store.best_version(blobs.where("full_file"), "file_path")
    joined = requests.join(full.select("file_path", "file_mtime", "file_size", "file_ctime", "content"), F.col("path") == F.col("file_path"), "left")
    s = snapshot.select(F.col("path").alias("__p"), *(F.col(x).alias(f"now_{x}") for x in ("mtime", "size", "ctime")))
    joined = joined.join(s, F.col("path") == F.col("__p"), "left")
    cut = text.line_window("content", F.col("offset"), F.col("limit"))
    reason = F.when(F.col("file_path").isNull(), "no-blob").when(~unchanged(), "stale").when(cut.isNull(), "out-of-bounds")
    return joined.select(*requests.columns, F.when(reason.isNull(), cut).alias("window"), reason.alias("reason"))


def audit(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Verdict for each stored text (``path, content``, optional ``first_line``) against the file's text:
    ``deleted, identical, window-identical, redacted, non-comparable, divergent``."""
    a = actual.select(F.col("path").alias("__p"), F.col("content").alias("__now"))
    joined = stored.join(a, F.col("path") == F.col("__p"), "left")
    own, now = F.col("content"), F.col("__now")
    plain = text.strip_line_numbers(own)
    verdict = (
        F.when(F.col("__p").isNull(), "deleted").when(own.isNull() | now.isNull(), "non-comparable").when(text.content_hash(own) == text.content_hash(now), "identical")
        .when(own.contains("[redacted:"), "redacted").when(plain == now, "identical").when(now.contains(plain) & (plain != ""), "window-identical").otherwise("divergent")
    )
    return joined.select(*stored.columns, verdict.alias("verdict"))


def replay(blobs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per class of path (``intact, modified, deleted``): paths, rows and characters stored."""
    rows = with_snapshot(blobs.where("file_path is not null"), snapshot)
    kind = F.when(F.col("now_mtime").isNull(), "deleted").when(unchanged(), "intact").otherwise("modified")
    return rows.groupBy(kind.alias("class")).agg(F.count_distinct("file_path").alias("paths"), F.count("*").alias("rows"), F.sum("size").alias("chars"))


def elision_note(content: Column, tool: str, fidelity: bool = False) -> Column:
    """The text that stands for a repeated call, null where it would be no shorter."""
    cap = FIDELITY_CHARS if fidelity else RECALL_CHARS
    note = F.concat(F.lit(f"[{tool}: unchanged since the last call]\n"), F.left(content, F.lit(cap)))
    return F.when(F.length(content) > OVERHEAD, note)


def elision_report(calls: DataFrame, by: str = "tool") -> DataFrame:
    """By tool: calls that were answered by a note and the characters saved.  ``calls``: ``tool, content, note``."""
    some = calls.where("note is not null")
    return some.groupBy(by).agg(F.count("*").alias("elided"), F.sum(F.greatest(F.lit(0), F.length("content") - F.length("note"))).cast("bigint").alias("saved_chars"))


def stub_safe(events: DataFrame, newest: int = 256, evicted: DataFrame | None = None) -> DataFrame:
    """For each delivery (``session, seq, hash, epoch``): whether an earlier delivery of the same hash is
    still in the context: in the same epoch, with fewer than ``newest`` other hashes delivered since.
    Hashes in ``evicted`` (``hash``) are none.  Blocks of a session are what they leave of the ``newest`` hashes."""

    rows = scan.scan(events.select("session", "seq", "hash", "epoch"), "session", ["seq"], scan.LastHashes("hash", "epoch", newest))
    if evicted is None:
        return rows
    gone = evicted.select("hash").distinct().withColumn("__gone", F.lit(True))
    return rows.join(gone, "hash", "left").withColumn("safe", F.col("safe") & F.col("__gone").isNull()).select("session", "seq", "hash", "epoch", "safe")
