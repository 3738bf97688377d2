"""Readers, writers and streams."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from condense import schema
from condense.operators import meter
from condense.sources import blobs, config, dimensions, logs
from condense.streaming import stateful


def test_store_files(spark, tmp_path):
    index = tmp_path / "index.json"
    index.write_text(json.dumps({"rev": 3, "blobs": [{"hash": "a", "size": 1, "created_at": 5, "last_ref": 6, "full_file": True}, {"hash": "b", "size": 2, "created_at": 7, "last_ref": 8}]}))
    rows = blobs.read_index(spark, str(index)).orderBy("seq").collect()
    assert [(r.hash, r.seq, r.full_file) for r in rows] == [("a", 0, True), ("b", 1, None)]
    folder = tmp_path / "blobs"
    folder.mkdir()
    text = "héllo\nworld"
    (folder / hashlib.sha256(text.encode()).hexdigest()).write_text(text)
    (folder / ("0" * 64)).write_text("wrong name")
    got = blobs.read_folder(spark, str(folder))
    assert [r.content for r in got.collect()] == [text]
    assert blobs.rebuild(got).first().kind == "text"
    blobs.write(got, str(tmp_path / "v0"))
    assert blobs.lookup(blobs.read(spark, str(tmp_path / "v0")), ["x"]).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfabc")
    (tmp_path / "b.txt").write_bytes("hé".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"a\x00b")
    (tmp_path / "d.txt").write_bytes(b"")
    assert sorted(r.content for r in blobs.read_files(spark, str(tmp_path)).collect()) == ["abc", "hé"]
    snap = blobs.snapshot(spark, str(tmp_path))
    assert snap.count() == 4 and blobs.folder_signature(snap).where(F.col("path") == str(tmp_path)).first()["size"] == 4
    assert blobs.folder_signature(snap, most=2).count() == 0


def test_logs(spark, tmp_path):
    lines = [json.dumps({"v": 1, "t": "2024-01-01T00:00:00Z", "session": "s", "level": lv, "type": "x", "action": "y", "payload": "token = " + "b" * 20}) for lv in ("debug", "info", "error")] + ["{broken"]
    (tmp_path / "events-s.ndjson").write_text("\n".join(lines))
    e = logs.read(spark, str(tmp_path / "events-*.ndjson"))
    assert e.count() == 3 and e.where(logs.at_least(F.col("level"), "info")).count() == 2
    assert logs.stats(spark, str(tmp_path / "events-*.ndjson")).first().lines == 4
    logs.append(e, str(tmp_path / "out"), "error")
    assert logs.read(spark, str(tmp_path / "out")).count() == 1
    assert logs.older_than(spark, str(tmp_path / "events-*.ndjson"), 1).count() == 0
    b = spark.createDataFrame([("h", 1)], "hash string, size bigint")
    blobs.export(spark, str(tmp_path / "bundle"), {"a": 1}, b, e)
    out = spark.read.json(str(tmp_path / "bundle")).collect()
    assert len(out) == 5 and not any("bbbbbbbb" in r.body for r in out)


def test_dimensions(spark, tmp_path):
    p = tmp_path / "prices.json"
    p.write_text(json.dumps({"data": [{"id": "a/m", "pricing": {"prompt": "0.000003", "completion": "0.000015"}}, {"id": "bad", "pricing": {"prompt": "-1", "completion": "x"}}]}))
    rows = dimensions.prices_json(spark, str(p)).collect()
    assert len(rows) == 1 and round(rows[0].input_per_m, 6) == 3.0 and rows[0].cache_read_per_m is None
    c = tmp_path / "catalog.json"
    c.write_text(json.dumps({"V": {"models": {"M": {"limit": {"context": 100}}, "N": {"limit": {"context": 0}}}}}))
    assert [tuple(r) for r in dimensions.catalog(spark, str(c)).collect()] == [("v", "m", 100)]
    now = [0.0]
    cached = dimensions.Cached(lambda: object(), 10, lambda: now[0])
    first = cached.get()
    now[0] = 5
    assert cached.get() is first
    now[0] = 20
    assert cached.get() is not first


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.Config()
    config.save(config.merge(config.Config(), {"cap_blobs": 5, "prose_ratio": 1, "log_level": 3, "nope": 1}), path)
    assert config.load(path).cap_blobs == 5 and config.load(path).prose_ratio == 1.0 and config.load(path).log_level == "info"
    (tmp_path / "c.json").write_text("{broken")
    assert config.load(path) == config.Config()


def drain(spark, df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream_of(spark, df, path, files=2):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stateful.session_counts(stream_of(spark, e, str(tmp_path / "e")), ["error"], "user_id", "event_type", "ts")
    got = drain(spark, s, "fold", "complete")
    want = meter.session_snapshot(e, "user_id", "event_type", "ts", ["error"])
    assert sorted(map(str, got.select("user_id", "events", "n_error").collect())) == sorted(map(str, want.select("user_id", "events", "n_error").collect()))


def test_stateful_streams(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, i < 3) for i in range(12)], "key string, seq bigint, failed boolean")
    got = drain(spark, stateful.breaker(stream_of(spark, rows, str(tmp_path / "b"), 1)), "breaker").collect()
    assert [(r.seq, r.state) for r in sorted(got, key=lambda r: r.seq)] == [(2, "open"), (7, "half-open"), (8, "closed")]
    sizes = spark.createDataFrame([("k", i, n) for i, n in enumerate([10, 50_000, 20_000, 21_000, 60_000, 1_000])], "key string, seq bigint, size bigint")
    got = drain(spark, stateful.epochs(stream_of(spark, sizes, str(tmp_path / "e"), 1)), "epochs").collect()
    assert [(r.seq, r.epoch) for r in sorted(got, key=lambda r: r.seq)] == [(2, 1), (5, 2)]
    seen = spark.createDataFrame([("k", "a", 0), ("k", "a", 200_000), ("k", "b", 250_000), ("k", "a", 600_001)], "key string, item string, at_ms bigint")
    got = drain(spark, stateful.active(stream_of(spark, seen, str(tmp_path / "a"), 1)), "active").collect()
    assert sorted((r.item, r.at_ms) for r in got) == [("a", 0), ("a", 600_001), ("b", 250_000)]


def test_deliver_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "content string, ts_ms bigint, seq bigint")
    t = rows.withColumn("t", F.timestamp_millis("ts_ms"))
    assert drain(spark, stateful.deliver_once(stream_of(spark, t, str(tmp_path / "t"), 1), ["content"]), "once", "append").count() == 2


def test_ingest_over_batches_equals_one_batch(spark, tmp_path):
    """All columns after several batches, before and after compaction, as after a single one."""
    secret = "token ghp_" + "a1B2" * 9
    rows = [("a text", 1, 1, "/f", 10.0), ("b", 2, 2, None, None), ("a text", 3, 3, "/f", 10.0), (secret, 4, 4, "/f", 11.0), ("\x00\x01", 5, 5, None, None), (None, 6, 6, None, None), ("a text", 7, 7, "/f", 12.0), ("b", 8, 8, "/g", 1.0)]
    outputs = spark.createDataFrame(rows, "content string, ts_ms bigint, seq bigint, file_path string, file_mtime double")
    stores = {}
    for n in (1, 3, 8):
        path = str(tmp_path / f"store{n}")
        stateful.ingest(stream_of(spark, outputs, str(tmp_path / f"in{n}"), n), path, str(tmp_path / f"ck{n}")).awaitTermination()
        got = lambda: sorted(map(str, stateful.current(spark, path).collect()))  # noqa: B023, E731
        stores[n] = got()
        terms = sorted(map(str, stateful.index(spark, path).collect()))
        assert {r.content: r.seen for r in stateful.current(spark, path).collect()}["a text"] == 3
        stateful.compact(spark, path)
        assert got() == stores[n] and sorted(map(str, stateful.index(spark, path).collect())) == terms
    assert stores[1] == stores[3] == stores[8] and len(stores[1]) == 4
    assert not any(secret in x for x in stores[1]) and any("kind='binary'" in x for x in stores[1])
    assert sum("superseded=True" in x for x in stores[1]) == 1  # the redacted text; the other was read again later


def test_ingest_goes_on_after_compaction(spark, tmp_path):
    path, ck, inp = str(tmp_path / "store"), str(tmp_path / "ck"), str(tmp_path / "in")
    first = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "content string, ts_ms bigint, seq bigint")
    first.write.mode("append").parquet(inp)
    read = lambda: spark.readStream.schema(first.schema).parquet(inp)
    stateful.ingest(read(), path, ck).awaitTermination()
    stateful.compact(spark, path)
    spark.createDataFrame([("a", 5, 5)], first.schema).write.mode("append").parquet(inp)
    stateful.ingest(read(), path, ck).awaitTermination()
    for _ in range(2):
        got = {r.content: (r.seen, r.created_at, r.last_ref, r.seq) for r in stateful.current(spark, path).collect()}
        assert got == {"a": (2, 1, 5, 1), "b": (1, 2, 2, 2)}
        stateful.compact(spark, path)


def test_usage_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", ("m1", "m2", "none")[i % 3 if i % 2 else 0], 100 + i, 10 * i, i, 1_700_000_000 + 60 * i) for i in range(40)]
    u = spark.createDataFrame(rows, "session string, model string, input_tokens bigint, output_tokens bigint, cache_read bigint, at bigint").withColumn("t", F.timestamp_seconds("at"))
    prices = spark.createDataFrame([("m1", 2.0, 8.0, None), ("m2", 1.0, 3.0, 0.5)], "model string, input_per_m double, output_per_m double, cache_read_per_m double")
    got = drain(spark, stateful.usage_costs(stream_of(spark, u, str(tmp_path / "u"), 4), prices), "costs", "complete").collect()
    want = {}
    price = {r.model: r for r in prices.collect()}
    for s, m, i, o, c, at in rows:
        k = (s, m, at // 3600)
        n, cost = want.get(k, (0, 0.0))
        p = price.get(m)
        own = None if p is None else (max(i - c, 0) * p.input_per_m + o * p.output_per_m + c * (p.input_per_m * 0.1 if p.cache_read_per_m is None else p.cache_read_per_m)) / 1e6
        want[k] = (n + 1, None if own is None else cost + own)
    assert {(r.session, r.model, int(r.window.start.timestamp()) // 3600): r.requests for r in got} == {k: n for k, (n, _) in want.items()}
    for r in got:
        cost = want[(r.session, r.model, int(r.window.start.timestamp()) // 3600)][1]
        assert (r.cost is None) == (cost is None) and (cost is None or abs(r.cost - cost) < 1e-12)


def test_schemas():
    assert schema.struct(schema.BLOBS)["hash"].nullable is False and len(schema.struct(schema.USAGES)) == 6


def test_index_falls_back_to_files(spark, tmp_path):
    folder, index = tmp_path / "blobs", tmp_path / "index.json"
    folder.mkdir()
    text = "what is left"
    hash_ = hashlib.sha256(text.encode()).hexdigest()
    (folder / hash_).write_text(text)
    hashes = lambda: [r.hash for r in blobs.load(spark, str(index), str(folder)).collect()]
    assert hashes() == [hash_]  # no index
    for broken in ("", "{broken", '{"rev": 1, "blobs": []}'):
        index.write_text(broken)
        assert hashes() == [hash_]
    index.write_text(json.dumps({"rev": 1, "blobs": [{"hash": "a", "size": 1}]}))
    assert hashes() == ["a"]


def test_log_sink(spark, tmp_path):
    lines = [json.dumps({"v": 1, "t": "2024-01-01T00:00:00Z", "session": "s", "level": lv, "type": "x", "action": "y"}) for lv in ("debug", "info", "warn", "error")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(lines))
    for q in logs.sink(logs.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), every=None):
        q.awaitTermination()
    level = lambda name: sorted(r.level for r in logs.read(spark, str(tmp_path / "out" / name)).collect())
    assert level("urgent") == ["error", "warn"] and level("batched") == ["info"]


def test_scratch_scopes_of_threads(spark):
    """A scope ends with its own tables only."""
    import threading

    from condense.sources import scratch

    inside, done, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch.scope(spark):
            t = scratch.stored(spark.range(3), "other")
            inside.set()
            done.wait(60)
            seen.append(t.count())

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with scratch.scope(spark):
        own = scratch.stored(spark.range(5), "own")
        assert own.count() == 5
    done.set()
    thread.join()
    assert seen == [3] and not scratch._path(spark, own.stored_at)[1].exists(scratch._path(spark, own.stored_at)[0])


def test_mask_allowed(spark):
    from condense.functions import scores

    df = spark.createDataFrame([(100,), (99,)], "t int")
    assert [tuple(r) for r in df.select(scores.mask_allowed("t", 100), scores.mask_allowed("t", 0)).collect()] == [(True, True), (False, True)]
