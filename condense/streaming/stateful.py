"""Streams of events: folds, breakers, time-to-live sets, heartbeats, epochs, ingest.

What one aggregate can hold is an aggregate; a sequence of states is a stateful function with one
small value a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import redact, text
from ..operators import meter, search, store


def session_counts(events: DataFrame, kinds: list[str], key: str = "session", kind: str = "type", at: str = "t") -> DataFrame:
    """The session fold as a streaming aggregate, for update or complete mode.  Without a watermark, as a
    session may come back at any time: the state is one small row for every session seen."""
    return meter.session_snapshot(events, key, kind, at, kinds)


def deliver_once(rows: DataFrame, keys: list[str], at: str = "t", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str, key: str, at: str = "t", late: str = "10 minutes") -> DataFrame:
    """Counts by event time and key; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def heartbeats(beats: DataFrame, key: str = "session", at: str = "t", grace: str = "30 seconds") -> DataFrame:
    """Sessions of beats with no gap longer than the grace time."""
    return beats.withWatermark(at, grace).groupBy(F.session_window(at, grace), key).agg(F.count("*").alias("beats"))


def breaker(rows: DataFrame, threshold: int = 3, rest: int = 5) -> DataFrame:
    """Circuit breaker of each ``key``; input ``key, seq, failed`` in order, output a row a change."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, turns = state.get if state.exists else ("closed", 0, 0)
        out = []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            before = name
            if name == "open":
                turns += 1
                if turns >= rest:
                    name, turns = "half-open", 0
            elif r.failed:
                failures += 1
                if name == "half-open" or failures >= threshold:
                    name, turns = "open", 0
            else:
                name, failures, turns = "closed", 0, 0
            if name != before:
                out.append((key[0], r.seq, name, failures))
        state.update((name, int(failures), int(turns)))
        yield pd.DataFrame(out, columns=["key", "seq", "state", "failures"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, state string, failures int", "state string, failures int, turns int", "update", GroupStateTimeout.NoTimeout)


def epochs(rows: DataFrame, share: float = 0.9, least_drop: int = 20_000) -> DataFrame:
    """Context epochs of each ``key``; input ``key, seq, size``, output a row an epoch."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, epoch = state.get if state.exists else (0, 0)
        out = []
        own = pd.concat(frames).sort_values("seq")
        for seq, size in zip(own["seq"], own["size"], strict=True):
            if size < peak * share and peak - size > least_drop:
                peak, epoch = size, epoch + 1
                out.append((key[0], seq, epoch))
            else:
                peak = max(peak, size)
        state.update((int(peak), int(epoch)))
        yield pd.DataFrame(out, columns=["key", "seq", "epoch"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, epoch long", "peak long, epoch long", "update", GroupStateTimeout.NoTimeout)


def active(rows: DataFrame, ttl_ms: int = 300_000, forget: bool = False) -> DataFrame:
    """Items mentioned within a time to live; input ``key, item, at_ms``, output mentions of items that were not
    active.  The state holds a key's items of the last ``ttl_ms``.  With ``forget``, a key that says
    nothing for that long loses its state; such a query never ends by itself."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items, at = state.get if state.exists else ([], [])
        seen, out = dict(zip(items, at, strict=True)), []
        for r in pd.concat(frames).sort_values("at_ms").itertuples():
            if r.at_ms - seen.get(r.item, -ttl_ms - 1) > ttl_ms:
                out.append((key[0], r.item, r.at_ms))
            seen[r.item] = int(r.at_ms)
        last = max(seen.values())
        seen = {k: v for k, v in seen.items() if last - v <= ttl_ms}
        state.update((list(seen), list(seen.values())))
        if forget:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["key", "item", "at_ms"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, item string, at_ms long", "items array<string>, at array<long>", "update", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def ingest(outputs: DataFrame, path: str, checkpoint: str, content_col: str = "content", at_col: str = "ts_ms", seq_col: str = "seq") -> StreamingQuery:
    """Take tool outputs into a store below ``path``, in micro-batches: secrets are redacted, contents are
    hashed and told binary or text, equal ones meet, and their terms are indexed.

    A batch writes its own rows only, to ``delta/batch=n`` and ``terms/batch=n`` (a batch that runs again
    writes the same anew), so its cost follows its size; :func:`current` merges them and
    :func:`compact` folds them into one.  Columns beside content, time and order go along from the
    newest output of a content."""

    def batch(df: DataFrame, n: int) -> None:
        clean = df.where(F.col(content_col).isNotNull()).withColumn(content_col, redact.redact(content_col)["text"])
        more = [c for c in df.columns if c not in (content_col, at_col, seq_col)]
        new = store.ingest(clean, content_col, at_col, seq_col)
        if more:
            last = clean.groupBy(text.content_hash(content_col).alias("hash")).agg(F.max_by(F.struct(*more), F.struct(at_col, seq_col)).alias("__m"))
            new = new.join(last, "hash").select(*new.columns, "__m.*")
        new.write.mode("overwrite").parquet(f"{path}/delta/batch={n}")
        search.postings(df.sparkSession.read.parquet(f"{path}/delta/batch={n}")).write.mode("overwrite").parquet(f"{path}/terms/batch={n}")

    return outputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


KEEP_FIRST = ("size", "kind", "seq", "content")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The store: what :func:`compact` has merged and the batches since, one row a hash, with ``superseded``
    and ``cause`` where rows have paths and versions."""
    rows = _merged(spark, path)
    return store.supersede(rows) if {"file_path", "file_mtime"} <= set(rows.columns) else rows


def _merged(spark: SparkSession, path: str) -> DataFrame:
    at, rows = _base(spark, path), spark.read.option("mergeSchema", True).parquet(f"{path}/delta")
    late = rows.where(F.col("batch") > at).drop("batch")
    # batches are merged with each other as they are with the base: by the same rule, whatever their number
    first = late.withColumn("__n", F.lit(1)) if at < 0 else spark.read.parquet(f"{path}/base/upto={at}").withColumn("__n", F.lit(0)).unionByName(late.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    place = F.struct("__n", "created_at", "seq")
    columns = [c for c in first.columns if c not in ("hash", "__n")]

    def merged(c: str):
        if c in ("last_ref", "created_at", "seen"):
            return {"last_ref": F.max, "created_at": F.min, "seen": F.sum}[c](c).alias(c)
        own = F.when(F.col(c).isNotNull(), place if c in KEEP_FIRST else F.struct("__n", "last_ref", "seq"))
        return (F.min_by if c in KEEP_FIRST else F.max_by)(c, own).alias(c)

    return first.groupBy("hash").agg(*map(merged, columns)).select("hash", *columns)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=n`` that were written to the end."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{name}=")]
    done = [f for f in found if fs.exists(_folder(spark, f"{f.toString()}/_SUCCESS")[0])]
    return sorted(int(f.getName().split("=")[1]) for f in done)


def _base(spark: SparkSession, path: str) -> int:
    return max(_numbers(spark, f"{path}/base", "upto"), default=-1)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Postings ``term, id, tf`` of the store, each once."""
    return spark.read.parquet(f"{path}/terms").select("term", "id", "tf").distinct()


def compact(spark: SparkSession, path: str) -> None:
    """Merge all batches into ``base/upto=n`` and delete the batches and the base before.  Between two
    runs of the stream: readers see the old state until the new base is complete."""
    batches = _numbers(spark, f"{path}/delta", "batch")
    at = _base(spark, path)
    if not batches or batches[-1] <= at:
        return
    _merged(spark, path).write.mode("overwrite").parquet(f"{path}/base/upto={batches[-1]}")
    old = [f"{path}/base/upto={at}"] if at >= 0 else []
    for gone in [f"{path}/delta/batch={n}" for n in batches[:-1]] + old:
        p, fs = _folder(spark, gone)
        fs.delete(p, True)


def usage_costs(usages: DataFrame, prices: DataFrame, at: str = "t", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, tokens and cost by window of event time, session and model: a stream of ``session, model,
    input_tokens, output_tokens, cache_read`` joined with a price table (``model, input_per_m, output_per_m,
    cache_read_per_m``, a row a model as :func:`condense.operators.meter.match_models` gives it).  The
    watermark bounds the state; models without a price cost null."""
    fresh = F.greatest(F.col("input_tokens") - F.col("cache_read"), F.lit(0))
    cached = F.coalesce("cache_read_per_m", F.col("input_per_m") * meter.CACHE_SHARE)
    cost = (fresh * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m") + F.col("cache_read") * cached) / 1e6
    rows = usages.withWatermark(at, late).join(F.broadcast(meter.bounded(prices)), "model", "left")
    return rows.groupBy(F.window(at, width), "session", "model").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read").alias("cache_read"), F.sum(cost).alias("cost"),
    )
