"""Strings by an automaton, intervals by bins, many path terms, revisions with several writers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from condense.operators import intervals, matching, meter, pathkeys, search
from condense.sources.scratch import shared_dir
from condense.sources.snapshots import Conflict, Snapshots


def test_hits(spark):
    rng = random.Random(1)
    strings = ["ab", "aba", "b", "é", "abab", "zz", "", "ab"]
    texts = ["".join(rng.choices("abé", k=rng.randrange(0, 15))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").withColumn("string", F.lit("clash")).repartition(3)
    got = {(r.i, r.string): (r["at"], r.n) for r in matching.hits(df, "t", strings, ["i"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        for s in set(strings) - {""}:
            places = [k + 1 for k in range(len(t or "")) if t.startswith(s, k)]
            if places:
                want[i, s] = (places[0], len(places))
    assert got == want
    order = ["zz", "é", "ab", "b"]
    first = {r.i: (r.term, r["at"]) for r in matching.first_of(df, "t", order).collect()}
    assert first == {i: next(((s, t.index(s) + 1) for s in order if t and s in t), (None, 0)) for i, t in enumerate(texts)}
    assert matching.hits(df, "t", [], ["i"]).count() == 0 and matching.first_of(df, "t", [""]).where("term is not null").count() == 0
    with pytest.raises(ValueError):
        matching.dimension(df, "t", 3)


def test_models_without_nested_loop(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["gpt", "sonnet", "mini", "x", "pro-1", "Big", "o1"])
    names = list({"/".join(part() for _ in range(rng.randrange(1, 3))) + rng.choice(["", "-v2", " "]) for _ in range(40)})
    prices = list({"/".join(part() for _ in range(rng.randrange(1, 3))) for _ in range(25)})
    p = spark.createDataFrame([(x, float(i), 1.0, None) for i, x in enumerate(prices)], "id string, input_per_m double, output_per_m double, cache_read_per_m double")
    df = spark.createDataFrame([(x,) for x in [*names, None]], "model string")
    out = meter.match_models(df, p)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    norm = lambda s: s.lower().strip(" ")
    last = lambda s: s.split("/")[-1]
    want = {}
    for n in names:
        a = norm(n)
        best = []
        for q in prices:
            b = norm(q)
            place = 1 if a == b else 2 if last(a) == last(b) else 3 if len(last(b)) >= 3 and last(b) in a else 4 if len(last(a)) >= 3 and last(a) in b else None
            if place:
                best.append((place, q))
        if best:
            want[n] = min(best)[1]
    assert {r.model: r.price_id for r in out.collect()} == want and len(want) > 20


def test_intervals(spark):
    rng = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            start = rng.randrange(-500, 4000)
            size = rng.choice([0, 1, 3, 15, 16, 17, 200, 5000, -2])
            out.append((rng.choice(["a", "a", "a", "b", None]), start, start + size if rng.random() > 0.05 else None, i))
        return out

    left, right = some(150), some(130)
    a = spark.createDataFrame(left, "k string, s bigint, e bigint, i int")
    b = spark.createDataFrame(right, "k string, t int, f int, j int")
    fine = lambda rows: [r for r in rows if r[0] is not None and r[2] is not None and r[1] <= r[2]]
    want = sorted((x[3], y[3]) for x in fine(left) for y in fine(right) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    for copies in (1, 4):
        out = intervals.overlaps(a, b, ["k"], ("s", "e"), ("t", "f"), copies)
        assert out.columns == ["k", "s", "e", "i", "t", "f", "j"] and sorted((r.i, r.j) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert len(want) > 500 and intervals.overlaps(a.limit(0), b, ["k"], ("s", "e"), ("t", "f")).count() == 0


def test_hot_bin_is_split(spark):
    """Rows of one bin of one key are dealt to several groups."""
    a = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("s"), (F.col("id") % 7 + 1).alias("e"), F.col("id").alias("i"))
    b = spark.createDataFrame([("k", 0, 3, 1)], "k string, t bigint, f bigint, j int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = intervals.overlaps(a, b, ["k"], ("s", "e"), ("t", "f"), copies=16)
        assert out.where("s <= 3").count() == out.count() == a.where("s <= 3").count()
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_path_terms(spark):
    rng = random.Random(4)
    keys = ["/".join("".join(rng.choices("abc.", k=rng.randrange(0, 5))) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    index = spark.createDataFrame([(k, i % 90) for i, k in enumerate(keys)], "term string, id bigint")
    terms = list({"".join(rng.choices("abc./", k=rng.randrange(1, 6))) for _ in range(80)}) + ["", " A "] + keys[:5]
    asked = spark.createDataFrame([(t,) for t in [*terms, None]], "lookup string")
    want = set()
    for t in terms:
        x = t.strip(" ").lower()
        if x:
            exact = {k for k in keys if k == x}
            some = exact or {k for k in keys if len(k) > len(x) and (k.endswith(x) or x in k.split("/")[-1])}
            want |= {(t, i % 90) for i, k in enumerate(keys) if k in some}
    got = {(r.lookup, r.id) for r in pathkeys.lookup(index, asked).collect()}
    assert sorted(got - want) == [] and sorted(want - got) == [] and len(want) > 60
    for t in terms[:4]:
        if t.strip():
            assert {r.id for r in search.path_lookup(index, t).collect()} == {i for x, i in want if x == t}
    out = pathkeys.lookup(index, asked)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and pathkeys.lookup(index, asked.limit(0)).count() == 0


def test_snapshots_of_several_writers(spark):
    root = shared_dir(spark, "revisions-test")
    table = Snapshots(spark, root)
    assert table.read() is None and table.revisions() == []
    one = lambda i: spark.createDataFrame([(i, 0)], "k bigint, n bigint")
    failures = []

    def run(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    def add(w):
        own = Snapshots(spark, root)
        for i in range(4):
            own.append(one(w * 10 + i))

    writers = [threading.Thread(target=run, args=(lambda w=w: add(w),)) for w in range(3)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    assert not failures and table.revisions() == list(range(1, 13))
    assert sorted(r.k for r in table.read().collect()) == sorted(w * 10 + i for w in range(3) for i in range(4))
    assert table.read(5).count() == 5  # an old revision, as it was

    raised = lambda df: df.withColumn("n", F.col("n") + 1)
    reader = table.read()
    raisers = [threading.Thread(target=run, args=(lambda: [Snapshots(spark, root).update(raised) for _ in range(2)],)) for _ in range(2)]
    [t.start() for t in raisers]
    [t.join() for t in raisers]
    assert not failures and {r.n for r in table.read().collect()} == {4} and {r.n for r in reader.collect()} == {0}
    with pytest.raises(Conflict):
        table._publish(3, [], one(1).schema)
    with pytest.raises(ValueError):
        table.append(spark.range(1))
    assert table.expire(keep=1) == 0  # none is old enough to be without readers
    assert table.expire(keep=1, grace_s=0) == 15 and table.revisions() == [16] and table.read().count() == 12
    names = [s.getPath().getName() for s in table.fs.listStatus(table._path(table.root))]
    assert sorted(names) == sorted(["_revisions", *table.manifest()["folders"]])
    table.update(lambda df: df.where("k < 0"))
    assert table.read().count() == 0
