"""The content-addressed store as tables: upsert, supersession, invalidation, eviction, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect, text
from . import ordered

CAP_BYTES, CAP_BLOBS = 48 << 20, 9000


def ingest(outputs: DataFrame, content_col: str = "content", at_col: str = "ts_ms", seq_col: str = "seq") -> DataFrame:
    """One row for each different content: ``hash, size, created_at, last_ref, kind, seen, seq`` and the
    content.  Equal contents meet by their hash and are combined before the shuffle."""
    rows = outputs.select(text.content_hash(content_col).alias("hash"), F.col(content_col).alias("content"), F.col(at_col).alias("at"), F.col(seq_col).alias("seq"))
    one = rows.groupBy("hash").agg(
        F.first("content").alias("content"), F.min("at").alias("created_at"), F.max("at").alias("last_ref"), F.count("*").alias("seen"), F.min("seq").alias("seq")
    )
    return one.select(
        "hash", F.length("content").cast("bigint").alias("size"), "created_at", "last_ref", F.when(detect.is_binary("content"), "binary").otherwise("text").alias("kind"), "seen", "seq", "content"
    )


def upsert(store: DataFrame, incoming: DataFrame, key: str = "hash", keep_first: tuple[str, ...] = ("size", "kind", "session", "content_at")) -> DataFrame:
    """Both tables' rows, one a key: ``keep_first`` columns and values that are null in the new row come
    from the stored one, ``created_at`` is the earlier and ``last_ref`` the later of both, whichever
    came first, and ``seen`` adds up."""
    a = store.withColumn("__new", F.lit(0))
    b = incoming.withColumn("__new", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "__new")]

    def merged(c: str) -> Column:
        place = F.when(F.col(c).isNotNull(), F.col("__new"))
        if c in ("last_ref", "created_at", "seen"):
            return {"last_ref": F.max, "created_at": F.min, "seen": F.sum}[c](c).alias(c)
        return (F.min_by(c, place) if c in keep_first else F.max_by(c, place)).alias(c)

    return both.groupBy(key).agg(*(merged(c) for c in cols)).select(*store.columns, *(c for c in incoming.columns if c not in store.columns))


def revision(*revisions: Column) -> Column:
    """The revision of a merged index: the largest of all."""
    return F.greatest(*(F.coalesce(r, F.lit(0)) for r in revisions))


def merge_index(memory: DataFrame, disk: DataFrame, contents: DataFrame) -> DataFrame:
    """Checkpoint: rows in memory win over those on disk; rows without content go."""
    only = disk.join(memory.select("hash"), "hash", "left_anti")
    return memory.unionByName(only, allowMissingColumns=True).join(contents.select("hash"), "hash", "left_semi")


def newest_version(blobs: DataFrame, path: str = "file_path", version: str = "file_mtime") -> DataFrame:
    """Latest version of each path, and the hash of (one of) its rows."""
    rows = blobs.where(F.col(path).isNotNull() & F.col(version).isNotNull())
    return rows.groupBy(path).agg(F.max(version).alias("__newest"), F.max_by("hash", F.struct(version, "hash")).alias("__hash"))


def supersede(blobs: DataFrame, path: str = "file_path", version: str = "file_mtime") -> DataFrame:
    """``blobs`` with ``superseded boolean, cause``: rows of which the path has a later version with another
    hash (a file that was only touched supersedes nothing).  The latest version a path is found by a
    map-side combined maximum, so a hot path is no hot task."""
    marked = blobs.join(newest_version(blobs, path, version), path, "left")
    old = F.coalesce((F.col(version) < F.col("__newest")) & (F.col("hash") != F.col("__hash")), F.lit(False))
    cause = F.when(old, F.when(F.col("source") == "read_file", "edited").otherwise("re-ingested")) if "source" in blobs.columns else F.when(old, "edited")
    return marked.select(*blobs.columns, old.alias("superseded"), cause.alias("cause"))


def live(blobs: DataFrame, path: str = "file_path", version: str = "file_mtime") -> DataFrame:
    """Without superseded rows."""
    return supersede(blobs, path, version).where("not superseded").select(*blobs.columns)


def ancestors(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: p != "")


def invalidate(blobs: DataFrame, edits: DataFrame, path: str = "file_path", scans: tuple[str, ...] = ("grep", "glob", "list_directory")) -> DataFrame:
    """Mark rows ``edited`` whose path was edited (``edits``: ``path``): equal paths, and for searches and
    listings also where either path is above the other.  The containment test is made an equality
    by exploding ancestors, so nothing is joined by nested loops."""
    e = edits.where("path is not null").select(F.regexp_replace("path", "(?<=.)/+$", "").alias("__edit")).distinct()
    up = e.select(F.explode(ancestors(F.col("__edit"))).alias("__key")).distinct()
    own = blobs.withColumn("__path", F.regexp_replace(path, "(?<=.)/+$", ""))
    is_scan = F.col("source").isin(*scans)
    exact = own.join(e.withColumnRenamed("__edit", "__path").withColumn("__same", F.lit(True)), "__path", "left")
    above = exact.join(up.select(F.col("__key").alias("__path"), F.lit(True).alias("__above")), "__path", "left")
    keys = own.where(is_scan & F.col("__path").isNotNull()).select("__path").distinct().withColumn("__key", F.explode(ancestors(F.col("__path"))))
    below = keys.join(e.withColumnRenamed("__edit", "__key"), "__key", "left_semi").select("__path").distinct().withColumn("__below", F.lit(True))
    hit = F.coalesce("__same", F.lit(False)) | (is_scan & (F.coalesce("__above", F.lit(False)) | F.coalesce("__below", F.lit(False))))
    return above.join(below, "__path", "left").select(*blobs.columns, F.coalesce(hit, F.lit(False)).alias("edited"))


def newest_per_command(blobs: DataFrame) -> DataFrame:
    """``blobs`` with ``supplanted``: the same call has a later output with other content."""
    key = [F.col("source").alias("__s"), F.coalesce("command", F.lit("")).alias("__c")]
    newest = blobs.groupBy(*key).agg(F.max_by("hash", F.struct("last_ref", "seq")).alias("__newest"))
    joined = blobs.join(newest, F.col("source").eqNullSafe(F.col("__s")) & (F.coalesce("command", F.lit("")) == F.col("__c")), "left")
    return joined.select(*blobs.columns, (F.col("hash") != F.col("__newest")).alias("supplanted"))


def best_version(blobs: DataFrame, path: str = "file_path") -> DataFrame:
    """One row a path: full files first, then by last use, creation and order."""
    place = F.struct(F.coalesce(F.col("full_file"), F.lit(False)).cast("int"), "last_ref", "created_at", "seq")
    row = F.struct(*(F.col(c) for c in blobs.columns))
    return blobs.where(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(row, place).alias("r")).select("r.*")


def prior_versions(blobs: DataFrame, n: int = 5, path: str = "file_path") -> DataFrame:
    """The ``n`` most recent rows of each path, by merging short sorted lists."""
    from pyspark.sql import Window

    w = Window.partitionBy(path).orderBy(F.desc("last_ref"), F.desc("seq"))
    return blobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)  # Spark limits each group before the shuffle


def evict(blobs: DataFrame, now: Column, cap_bytes: int = CAP_BYTES, cap_blobs: int = CAP_BLOBS, least_age_ms: int = 30 * 60_000,
          active_sessions: list[str] | None = None) -> DataFrame:
    """The rows that go so that both caps hold (0: no cap): the longest unused first, none that is young
    or of an active session.  Sums run by buckets of time."""
    used = F.coalesce(F.nullif(F.col("last_ref"), F.lit(0)), F.col("created_at"))
    total = blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__bytes"), F.count("*").alias("__blobs"))
    can = F.lit(True)
    if least_age_ms > 0:
        can = (now - used > least_age_ms) & (now - F.col("created_at") > least_age_ms)
    if active_sessions:
        can = can & ~F.col("session").isin(*active_sessions)
    rows = blobs.withColumn("__used", used).where(can)
    rows = ordered.quantile_bucket(rows, F.col("__used"))
    rows = ordered.running_sum(rows, F.col("size"), [F.col("__used"), F.col("hash")], "__sum")
    rows = ordered.rank(rows, "__used", [F.col("hash")], "__place", descending=False)
    over = F.lit(False)
    if cap_bytes > 0:
        over = over | (F.col("__bytes") - (F.col("__sum") - F.col("size")) > cap_bytes)
    if cap_blobs > 0:
        over = over | (F.col("__blobs") - (F.col("__place") - 1) > cap_blobs)
    return rows.crossJoin(F.broadcast(total)).where(over).select(*blobs.columns)


def with_content(blobs: DataFrame, contents: DataFrame) -> DataFrame:
    return blobs.join(contents, "hash")


def prune_orphans(blobs: DataFrame, contents: DataFrame) -> DataFrame:
    return blobs.join(contents.select("hash"), "hash", "left_semi")


def collect_garbage(blobs: DataFrame, contents: DataFrame, now: Column, cap_bytes: int = CAP_BYTES, cap_blobs: int = CAP_BLOBS, least_age_ms: int = 30 * 60_000,
                    active_sessions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of the index and of the contents: rows that :func:`evict` names go, so do rows without
    content, and contents without a row."""
    gone = evict(blobs, now, cap_bytes, cap_blobs, least_age_ms, active_sessions).select("hash")
    left = prune_orphans(blobs.join(gone, "hash", "left_anti"), contents)
    return left, contents.join(left.select("hash"), "hash", "left_semi")


def purge(blobs: DataFrame, workspace: str | None = None) -> DataFrame:
    """What stays when a workspace, or everything, is purged."""
    return blobs.where(F.lit(False)) if workspace is None else blobs.where(~F.col("workspace").eqNullSafe(F.lit(workspace)))


def after_purge(blobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows made after the last purge (``tombstones``: ``purged_at``)."""
    last = F.broadcast(tombstones.agg(F.max("purged_at").alias("__at")))
    return blobs.crossJoin(last).where(F.col("__at").isNull() | (F.col("created_at") > F.col("__at"))).select(*blobs.columns)


def counts(blobs: DataFrame, *by: str) -> DataFrame:
    """Rows and characters by source, kind or level."""
    return blobs.groupBy(*by).agg(F.count("*").alias("blobs"), F.sum("size").alias("chars"))


def touch(blobs: DataFrame, served: DataFrame, at: Column, id_col: str = "hash") -> DataFrame:
    """The store after a recall: rows that it served (``id, stale``, as :func:`search.recall` gives them; at most its
    limit) were last used at ``at``, which keeps them from eviction.  Stale ones were not served."""
    used = served.where(~F.col("stale")).select(F.col("id").alias(id_col), F.lit(True).alias("__used")).distinct()
    joined = blobs.join(F.broadcast(used), id_col, "left")  # at most the limit of a recall
    last = F.when(F.col("__used"), F.greatest("last_ref", at.cast("bigint"))).otherwise(F.col("last_ref"))
    return joined.select(*(last.alias(c) if c == "last_ref" else F.col(c) for c in blobs.columns))
