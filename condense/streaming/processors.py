"""Streams with state of their own: sessions that die by a timer, breakers that start from a table, active items, playbooks.

Each is a processor for ``transformWithState``: named values, maps and timers of one key, which are dropped when the
key needs none.  State lives in RocksDB (:func:`prepare`), so it may be larger than memory, survives restarts
with the checkpoint, and can be read as a table (:func:`state`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import Breaker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Let queries of this session that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A named state of a query as a table, from its checkpoint."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


class Sessions(StatefulProcessor):
    """A session is born with its first beat and dead when the watermark has passed its last beat by the grace time."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "started long, last long, beats long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, last, beats = self.life.get() if self.life.exists() else (None, None, 0)
        for at in sorted(r.at_ms for r in rows):
            if last is not None and at - last > self.grace_ms:
                # the gap shows in the rows before the timer has come
                yield Row(session=key[0], event="dead", at_ms=last + self.grace_ms, beats=beats)
                started, beats = None, 0
            if started is None:
                started = at
                yield Row(session=key[0], event="born", at_ms=at, beats=0)
            last, beats = max(at, last or at), beats + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.grace_ms + 1)
        self.life.update((started, last, beats))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, last, beats = self.life.get()
        self.life.clear()
        yield Row(session=key[0], event="dead", at_ms=last + self.grace_ms, beats=beats)

    def close(self) -> None:
        pass


def sessions(beats: DataFrame, grace_s: int = 30, key: str = "session", at: str = "t", late: str = "30 seconds") -> DataFrame:
    """``session, event, at_ms, beats``: a row when a session is born and one, by a timer of event time, when it has
    died; beats later than the watermark are dropped.  A dead session has no state."""
    rows = beats.withWatermark(at, late).select(F.col(key).cast("string").alias("session"), F.col(at), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))
    return rows.groupBy("session").transformWithState(Sessions(grace_s * 1000), "session string, event string, at_ms long, beats long", "append", "eventTime")


class BreakerStates(StatefulProcessor):
    """The automaton of :class:`condense.operators.scan.Breaker`; a closed breaker without failures has no state."""

    def __init__(self, threshold: int, rest: int):
        self.machine = Breaker("failed", threshold, rest)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("breaker", "at int, failures long, opened long")

    def _next(self, now: tuple, failed: bool) -> tuple:
        s, m = int(bool(failed)), self.machine
        return (int(m.moves[s, now[0]]), *((0 if r[s, now[0]] else c) + int(a[s, now[0]]) for c, r, a in zip(now[1:], m.resets, m.adds, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.held.get()) if self.held.exists() else self.machine.start()
        for r in sorted(rows, key=lambda r: r.seq):
            before, now = self.machine.last(now)[0], self._next(now, r.failed)
            name, failures, opened = self.machine.last(now)
            if name != before:
                yield Row(key=key[0], seq=r.seq, state=name, failures=failures, opened=opened)
        if now == self.machine.start():
            self.held.clear()
        else:
            self.held.update(now)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.held.update((initialState.at, initialState.failures, initialState.opened))

    def close(self) -> None:
        pass


def breakers(rows: DataFrame, threshold: int = 3, rest: int = 5, initial: DataFrame | None = None) -> DataFrame:
    """A row for each change of a key's breaker; input ``key, seq, failed`` in order of ``seq`` from batch to batch.
    ``initial`` (``key, at, failures, opened``, as the state itself is read): where keys begin."""
    processor = BreakerStates(threshold, rest)
    first = None if initial is None else initial.select("key", "at", "failures", "opened").groupBy("key")
    return rows.groupBy("key").transformWithState(processor, "key string, seq long, state string, failures long, opened long", "append", "none", first)


class ActiveItems(StatefulProcessor):
    """Items of a key with the time of their last mention; a timer of event time drops each when it is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at_ms, r.item)):
            last = self.items.getValue((r.item,))[0] if self.items.containsKey((r.item,)) else None
            if last is None or r.at_ms - last > self.ttl_ms:
                yield Row(key=key[0], item=r.item, at_ms=r.at_ms)
            self.items.updateValue((r.item,), (max(r.at_ms, last or r.at_ms),))
            self.handle.registerTimer(r.at_ms + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms - 1
        for item, at in list(self.items.iterator()):
            if at[0] <= over:
                self.items.removeKey(item)
        return iter(())

    def close(self) -> None:
        pass


def active_items(mentions: DataFrame, ttl_s: int = 300, at: str = "t", late: str = "1 minute") -> DataFrame:
    """Mentions (``key, item`` and a time) of items that were not active: not mentioned within ``ttl_s`` before.  What is
    over is forgotten by a timer, so the state holds active items only."""
    rows = mentions.withWatermark(at, late).select("key", "item", F.col(at), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))
    return rows.groupBy("key").transformWithState(ActiveItems(ttl_s * 1000), "key string, item string, at_ms long", "append", "eventTime")


class PlaybookCounts(StatefulProcessor):
    """How often a path has helped and harmed, and when last; a path that nothing touches for the time to live is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "helpful long, harmful long, last_at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        helpful, harmful, last = self.counts.get() if self.counts.exists() else (0, 0, 0)
        for r in rows:
            helpful, harmful, last = helpful + bool(r.helped), harmful + (not r.helped), max(last, r.at)
        self.counts.update((helpful, harmful, last))
        yield Row(path=key[0], helpful=helpful, harmful=harmful, last_at=last)

    def close(self) -> None:
        pass


def playbook(touches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Counters of each path after each batch (``path, helpful, harmful, last_at``; the last row of a path is its newest) of a
    stream ``path, helped, at``."""
    mode = "none" if ttl_ms is None else "processingTime"
    return touches.groupBy("path").transformWithState(PlaybookCounts(ttl_ms), "path string, helpful long, harmful long, last_at long", "update", mode)
