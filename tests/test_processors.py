"""Streams with state: equal to loops after a restart, timers, initial state, state that shrinks."""

import pytest
from pyspark.sql import functions as F

from condense.operators import convo
from condense.streaming import processors


@pytest.fixture
def stateful(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.prepare(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


class Feed:
    """A folder that a stream reads, batch by batch, with a restart before each."""

    def __init__(self, spark, tmp_path, schema, make, mode="append"):
        self.spark, self.path, self.check, self.schema, self.make, self.mode = spark, str(tmp_path / "in"), str(tmp_path / "check"), schema, make, mode
        self.out, self.n = str(tmp_path / "out"), 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(self.path)
        src = self.spark.readStream.schema(self.schema).json(self.path)
        self.n += 1
        q = self.make(src).writeStream.outputMode(self.mode).option("checkpointLocation", self.check).trigger(availableNow=True)
        q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.out}/{self.n}-{n}")).start().awaitTermination()

    def rows(self):
        return [tuple(r) for r in self.spark.read.option("recursiveFileLookup", True).parquet(self.out).collect()]


def ts(ms):
    return f"2024-01-01T00:{ms // 60000:02d}:{ms % 60000 / 1000:06.3f}Z"


def test_sessions_die_by_a_timer(stateful, tmp_path):
    feed = Feed(stateful, tmp_path, "session string, t timestamp", lambda s: processors.sessions(s, 30, late="5 seconds"))
    at = lambda k, ms: (k, __import__("datetime").datetime.fromisoformat(ts(ms)))
    feed.add([at("a", 0), at("a", 20_000), at("b", 10_000)])
    feed.add([at("a", 100_000), at("c", 101_000)])  # a comes back after a gap; b is past its grace
    feed.add([at("c", 200_000), at("d", 400_000)])
    feed.add([at("d", 500_000)])
    base = min(r[2] for r in feed.rows())
    got = sorted((r[0], r[1], r[2] - base, r[3]) for r in feed.rows())
    assert got[:4] == [("a", "born", 0, 0), ("a", "born", 100_000, 0), ("a", "dead", 50_000, 2), ("a", "dead", 130_000, 1)]
    assert [r for r in got if r[0] == "b"] == [("b", "born", 10_000, 0), ("b", "dead", 40_000, 1)]
    assert [r[1:3] for r in got if r[0] == "c"] == [("born", 101_000), ("born", 200_000), ("dead", 131_000), ("dead", 230_000)]
    left = {r.key.session for r in processors.state(stateful, feed.check, "life").collect()}
    assert left <= {"d"}  # the dead have no state


def test_breakers_go_on_after_a_restart(stateful, tmp_path):
    schema = "key string, seq long, failed boolean"
    rows = [(f"k{i % 3}", i, (i * 7919 % 11) < 9) for i in range(120)]
    feed = Feed(stateful, tmp_path, schema, processors.breakers)
    for part in (rows[:50], rows[50:51], rows[51:]):
        feed.add(part)
    batch = convo.breaker_states(stateful.createDataFrame(rows, schema), "key", "seq", "failed").collect()
    want, before = [], {}
    for r in sorted(batch, key=lambda r: r.seq):
        if r.state != before.get(r.key, "closed"):
            want.append((r.key, r.seq, r.state, r.failures, r.opened))
        before[r.key] = r.state
    assert sorted(feed.rows()) == sorted(want) and len(want) > 10
    feed.add([(f"k{k}", 1000 + i, False) for k in range(3) for i in range(12)])
    held = processors.state(stateful, feed.check, "breaker")
    assert held.count() == 3 and {r.value.at for r in held.collect()} == {0}  # closed, with how often they opened
    start = stateful.createDataFrame([("k9", 2, 2, 0)], "key string, at int, failures long, opened long")
    other = Feed(stateful, tmp_path / "initial", schema, lambda s: processors.breakers(s, initial=start))
    other.add([("k9", 1, True), ("k8", 1, True)])
    assert other.rows() == [("k9", 1, "open", 3, 1)]


def test_active_items_are_forgotten(stateful, tmp_path):
    at = lambda k, i, ms: (k, i, __import__("datetime").datetime.fromisoformat(ts(ms)))
    feed = Feed(stateful, tmp_path, "key string, item string, t timestamp", lambda s: processors.active_items(s, 60, late="1 second"))
    feed.add([at("k", "x", 0), at("k", "x", 30_000), at("k", "y", 10_000)])
    feed.add([at("k", "x", 85_000), at("k", "y", 90_000)])
    feed.add([at("m", "z", 900_000)])
    feed.add([at("m", "z", 901_000)])
    got = sorted((r[0], r[1]) for r in feed.rows())
    assert got == [("k", "x"), ("k", "y"), ("k", "y"), ("m", "z")]  # x never was over, y was
    assert {r.key.key for r in processors.state(stateful, feed.check, "items").collect()} == {"m"}


def test_playbook_counts(stateful, tmp_path):
    feed = Feed(stateful, tmp_path, "path string, helped boolean, at long", processors.playbook, "update")
    feed.add([("p", True, 5), ("q", False, 6), ("p", False, 9)])
    feed.add([("p", True, 7)])
    last = {}
    for r in sorted(feed.rows(), key=lambda r: r[1] + r[2]):
        last[r[0]] = r[1:]
    assert last == {"p": (2, 1, 9), "q": (0, 1, 6)}
    assert processors.state(stateful, feed.check, "counts").agg(F.count("*")).first()[0] == 2
