"""Parallel scans, halos and sums by buckets against loops, with hot and null keys and 64-bit numbers."""

import math
import random
from collections import OrderedDict, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condense.operators import convo, meter, ordered, scan, serve

BIG = 2**53


def keyed(seed, n, keys, value):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, value(rng)) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for k, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out[k].append((i, v))
    return out


def breaker(flags, threshold=3, rest=5):
    state, failures, turns, opened, out = "closed", 0, 0, 0, []
    for bad in flags:
        if state == "open":
            turns += 1
            state = "half-open" if turns >= rest else "open"
        elif not bad:
            state, failures = "closed", 0
        else:
            failures += 1
            if state == "half-open" or failures >= threshold:
                state, turns, opened = "open", 0, opened + 1
        out.append((state, failures, opened))
    return out


@pytest.mark.parametrize(("threshold", "rest"), [(3, 5), (1, 1), (2, 3)])
def test_breaker(spark, threshold, rest):
    rows = keyed(1, 900, [BIG, BIG + 1, None, *[BIG] * 5, 7], lambda r: r.choice([True, True, False, None]))
    df = spark.createDataFrame(rows, "k bigint, i bigint, bad boolean")
    want = {k: breaker([v for _, v in own], threshold, rest) for k, own in by_key(rows).items()}
    got = {r.k: (r.state, r.failures, r.opened) for r in convo.breaker(df, "k", "i", "bad", threshold, rest).collect()}
    assert got == {k: v[-1] for k, v in want.items()}
    each = scan.scan(df, "k", ["i"], scan.Breaker("bad", threshold, rest), block_rows=7).collect()
    assert {(r.k, r.i): (r.state, r.failures, r.opened) for r in each} == {(k, i): s for k, own in by_key(rows).items() for (i, _), s in zip(own, want[k], strict=True)}
    assert convo.breaker(df.limit(0), "k", "i", "bad").count() == 0


def epochs(sizes, share=0.9, drop=20):
    peak, epoch, out = 0, 0, []
    for s in sizes:
        if s is not None:
            if s < peak * share and peak - s > drop:
                peak, epoch = s, epoch + 1
            else:
                peak = max(peak, s)
        out.append(epoch)
    return out


def test_reset_peak_blocks():
    rng = random.Random(4)
    for share, drop in ((0.9, 20), (0.5, 0), (0.99, 3)):
        machine = scan.ResetPeak("s", share, drop)
        for _ in range(400):
            xs = [rng.choice([None, rng.randrange(200), rng.randrange(200), rng.randrange(30) + BIG]) if rng.random() < 0.1 else rng.randrange(200) for _ in range(rng.randrange(1, 25))]
            rows = pa.table({"s": pa.array(xs, pa.int64())})
            for peak in [0, *(rng.randrange(260) for _ in range(6)), BIG + 7]:
                p, e = peak, 0
                for v in xs:
                    if v is not None:
                        if v < p * share and p - v > drop:
                            p, e = v, e + 1
                        else:
                            p = max(p, v)
                assert machine.after((peak, 5), machine.summary(rows)) == (p, 5 + e), (xs, peak)


def test_epochs(spark):
    rows = [(k, BIG + i, v) for k, i, v in keyed(2, 1200, [1, 1, 1, None, BIG + 1, BIG], lambda r: r.choice([None, r.randrange(300), r.randrange(300)]))]
    rows += [(1, None, 250), (99, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, size bigint").withColumn("more", F.array(F.lit("x")))
    want = {(k, i): e for k, own in by_key(rows).items() for (i, _), e in zip(own, epochs([v for _, v in own]), strict=True)}
    out = convo.epochs(df, least_drop=20)
    assert out.columns == [*df.columns, "epoch"]
    assert {(r.conv_id, r.turn): r.epoch for r in out.collect()} == want and max(want.values()) > 5
    small = scan.scan(df, "conv_id", ["turn"], scan.ResetPeak("size", 0.9, 20), block_rows=3)
    assert {(r.conv_id, r.turn): r.epoch for r in small.collect()} == want
    assert convo.epochs(df.limit(0)).count() == 0


def test_hot_key_is_spread(spark):
    """A key with most rows has blocks in every partition, and no task of the scan has more than a row a block."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 1000).alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions are small here
    try:
        cut = scan.blocks(df, "k", ["i"], scan.ResetPeak("size", 0.9, 20), 1000).where("key = -1")
        parts = cut.select(F.spark_partition_id().alias("p"), F.size("rows").alias("n")).groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r.n for r in parts) < 20_000 and sum(r.blocks for r in parts) < 60


def test_running_mean_and_fit(spark):
    rows = keyed(3, 700, ["a", "a", "a", "b", None], lambda r: (r.randrange(0, 4000), r.randrange(0, 900)))
    df = spark.createDataFrame([(k, i, *v) for k, i, v in rows], "k string, i bigint, ascii bigint, tokens bigint")
    want = {}
    for k, own in by_key(rows).items():
        n, mean, past = 0, 0.0, []
        for i, (a, t) in own:
            if a > 0 and t > 0:
                mean += (a / t - mean) / min(n + 1, 8)
                n += 1
                past = [*past, (a, t)][-20:]
                x, y = (sum(c) / len(past) for c in zip(*past, strict=True))
                sxx = sum((p - x) ** 2 for p, _ in past)
                slope = sum((p - x) * (q - y) for p, q in past) / sxx if sxx else 0.0
                want[k, i] = (n, mean, len(past), slope, y - slope * x if sxx else 0.0, 1 / slope if len(past) >= 5 and slope > 0 else mean)
    out = meter.running_estimates(df, "k", "i", memory=8, fitted=20).collect()
    assert len(out) == len(want)
    for r in out:
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip((r.samples, r.chars_per_token, r.fitted, r.slope, r.intercept, r.estimate), want[r.k, r.i], strict=True)), (r, want[r.k, r.i])
    ends = {k: max(i for kk, i in want if kk == k) for k, _ in want}
    got = {r.k: r for r in meter.running_ratio(df.withColumn("chars", F.col("ascii")), "k", "i", memory=8).collect()}
    assert set(got) == set(ends) and all(got[k].samples == want[k, i][0] and math.isclose(got[k].chars_per_token, want[k, i][1], rel_tol=1e-9) for k, i in ends.items())
    for memory in (1, 5, 1 << 30):
        machine = scan.RunningMean("c", "t", memory)
        for before in (0, 3, 40):
            table = pa.table({"c": [5.0, 2.5, 9.0, 4.0, 1.0, 8.0, 3.0], "t": [2.0] * 7})
            n, mean = before, 1.25
            for c in table.column("c").to_pylist():
                mean += (c / 2 - mean) / min(n + 1, memory)
                n += 1
            got_n, got_mean = machine.after((before, 1.25), machine.summary(table))
            assert got_n == n and math.isclose(got_mean, mean, rel_tol=1e-12)


def test_stub_safe(spark):
    rows = keyed(5, 600, ["s", "s", "s", None, "t"], lambda r: (r.choice([None, *"abcdefgh"]), r.randrange(2)))
    df = spark.createDataFrame([(k, BIG + i, *v) for k, i, v in rows], "session string, seq bigint, hash string, epoch bigint")
    want = {}
    for k, own in by_key(rows).items():
        held = OrderedDict()
        for i, (h, e) in own:
            want[k, BIG + i] = h in held and held[h] == e
            held.pop(h, None)
            held[h] = e
            if len(held) > 4:
                held.popitem(last=False)
    for out in (serve.stub_safe(df, newest=4), scan.scan(df, "session", ["seq"], scan.LastHashes("hash", "epoch", 4), block_rows=5)):
        assert {(r.session, r.seq): r.safe for r in out.collect()} == want
    assert {True, False} == set(want.values())


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_buckets(spark, monkeypatch, width):
    """Windows by buckets are those over whole keys, whatever the buckets' width."""
    from pyspark.sql import Window

    monkeypatch.setattr(ordered.bucket_of, "__defaults__", (width,))
    rng = random.Random(6)
    turns = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(150)]
    rows = [(c, i, rng.choice(["tool", "user"]), rng.choice(["x" * 600, "error: no\n" + "y" * 600, "small", None]), False, rng.random() < 0.1) for c, i in turns]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string, is_error boolean, is_summary boolean")
    got = {(r.conv_id, r.turn): (r.verdict, r.masked) for r in convo.mask(m, keep_last=3, polling=4).collect()}
    monkeypatch.setattr(ordered.bucket_of, "__defaults__", (1 << 40,))
    assert got == {(r.conv_id, r.turn): (r.verdict, r.masked) for r in convo.mask(m, keep_last=3, polling=4).collect()} and len(got) == 150
    assert any(m for _, m in got.values()) and {v for v, _ in got.values()} >= {"first", "mask", "small", "error", None}
    monkeypatch.setattr(ordered.bucket_of, "__defaults__", (width,))
    u = spark.createDataFrame([(str(c) if c else None, i, rng.randrange(1000), rng.randrange(100), rng.choice("ab")) for c, i in turns], "session string, turn bigint, input_tokens bigint, cache_read bigint, tool string")
    w = Window.partitionBy("session").orderBy("turn")
    plain = u.withColumn("rise", F.col("input_tokens") - F.lag("input_tokens").over(w)).select(
        "turn", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.coalesce(F.avg("rise").over(w.rowsBetween(-8, 0)), F.lit(0.0))).alias("growth"),
        (F.sum("cache_read").over(w.rowsBetween(-9, 0)) / F.nullif(F.sum("input_tokens").over(w.rowsBetween(-9, 0)), F.lit(0))).alias("cache_ratio"),
        (F.lead("tool").over(w) == "a").alias("next"), "tool",
    ).collect()
    out = {r.turn: (r.growth, r.cache_ratio) for r in meter.growth(u).collect()}
    assert out == {r.turn: (r.growth, r.cache_ratio) for r in plain}
    assert {r.turn: r.dip for r in meter.cache_dips(u).collect()} == {r.turn: r.dip for r in u.withColumn("q", F.col("cache_read") / F.nullif("input_tokens", F.lit(0))).select("turn", F.coalesce(F.lag("q").over(w) - F.col("q") > 0.15, F.lit(False)).alias("dip")).collect()}
    assert {r.turn: r.followed for r in meter.followed_by(u, "b", ("a",), order="turn").collect()} == {r.turn: bool(r.next) for r in plain if r.tool == "b"}
    p = m.select("conv_id", "turn", F.coalesce("content", F.lit("")).alias("prefix"))
    frozen = {r.turn: (r.lcp_ratio, r.cause) for r in convo.frozen_prefix(p).collect()}
    monkeypatch.setattr(ordered.bucket_of, "__defaults__", (1 << 40,))
    assert frozen == {r.turn: (r.lcp_ratio, r.cause) for r in convo.frozen_prefix(p).collect()}
