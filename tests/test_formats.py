"""The data source, table functions and listings by tasks."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from condense.operators import search, tables
from condense.sources import blobs, format as fmt, listing


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_store_format(spark, tmp_path):
    fmt.register(spark)
    path = str(tmp_path / "store")
    texts = [f"text {i} é" for i in range(40)] + ["text 1 é"]
    df = spark.createDataFrame([(t, "w", i) for i, t in enumerate(texts)], "content string, workspace string, last_ref bigint").repartition(3)
    df.write.format("condense").option("path", path).mode("append").save()
    df.limit(0).write.format("condense").option("path", path).mode("append").save()
    read = lambda: spark.read.format("condense").load(path)
    rows = {r.hash: r for r in read().collect()}
    assert {h: r.content for h, r in rows.items()} == {sha(t): t for t in texts} and {r.workspace for r in rows.values()} == {"w"}
    assert rows[sha("text 1 é")].last_ref == 40 and not [n for n in os.listdir(path) if n.startswith(".")]
    some = read().where(F.col("hash").isin(sha("text 3 é"), sha("text 4 é"), "f" * 64))
    assert {r.content for r in some.collect()} == {"text 3 é", "text 4 é"}
    reader = fmt.StoreReader(path)
    every = len(reader.partitions())
    list(reader.pushFilters([fmt.In(("hash",), (sha("text 3 é"), sha("text 4 é")))]))
    assert len(reader.partitions()) == len({sha("text 3 é")[:2], sha("text 4 é")[:2]}) < every
    with open(f"{path}/index.json", "w") as f:
        f.write("{broken")
    with open(f"{path}/{'0' * 64}", "w") as f:
        f.write("a file that is not what its name says")
    assert {r.hash: r.content for r in read().collect()} == {sha(t): t for t in texts}  # rebuilt from the files
    os.remove(f"{path}/index.json")
    os.remove(f"{path}/{sha('text 0 é')}")
    assert read().count() == 39


def test_failed_write_leaves_nothing(spark, tmp_path):
    fmt.register(spark)
    path = str(tmp_path / "store")
    bad = spark.range(30).repartition(3).select(F.when(F.col("id") == 29, F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("id").cast("string")).alias("content"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("condense").option("path", path).mode("append").save()
    assert [n for n in os.listdir(path) if not n.startswith(".")] == []  # no reader sees any of it
    writer = fmt.StoreWriter(path, ["content"])
    done = writer.write(iter([("x",), (None,), ("x",)]))
    assert len(done.files) == 1
    writer.abort([done, None])
    assert not os.path.exists(done.files[0][0])


def test_log_format_and_stream(spark, tmp_path):
    fmt.register(spark)
    path, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    os.makedirs(path)
    line = lambda i: json.dumps({"type": "store", "session": "s", "level": "info", "t": f"T{i}", "n": i}) + "\n"
    with open(f"{path}/a.ndjson", "w") as f:
        f.write(line(0) + "broken\n" + line(1) + line(2)[:10])
    load = lambda r: r.format("condense").option("kind", "log")
    assert sorted(r["at"] for r in load(spark.read).load(path).collect()) == ["T0", "T1"]

    def drain():
        q = load(spark.readStream).load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["at"] for r in spark.read.parquet(out).collect())

    assert drain() == ["T0", "T1"]
    with open(f"{path}/a.ndjson", "a") as f:
        f.write(line(2)[10:] + line(3))
    with open(f"{path}/b.ndjson", "w") as f:
        f.write(line(4))
    assert drain() == ["T0", "T1", "T2", "T3", "T4"]  # each once, also the line that was cut


def test_recall_as_a_table_function(spark):
    tables.register(spark)
    rows = [(f"h{i}", f"w{i % 3}", None if i == 7 else f"err{i} and {'timeout' if i % 4 else 'Delay'} {'x' * (i * 100)}", i * 7 % 20) for i in range(30)]
    df = spark.createDataFrame(rows, "hash string, workspace string, content string, last_ref bigint")
    df.createOrReplaceTempView("store_rows")
    for query in ("err1[0-9]", "timeout", "[x", "DELAY err2"):
        got = spark.sql(f"SELECT * FROM recall(TABLE(store_rows) PARTITION BY workspace ORDER BY (last_ref DESC, hash), '{query}', 3)").collect()
        want = set()
        for w in ("w0", "w1", "w2"):
            own = df.where(F.col("workspace") == w)
            found = own.where(search.found_at(F.col("content"), query) > 0).orderBy(F.desc("last_ref"), "hash").limit(3)
            want |= {(r.hash, i + 1) for i, r in enumerate(found.collect())}
        assert {(r.hash, r["rank"]) for r in got} == want
        assert all(len(r.snippet) <= tables.SNIPPET_CHARS for r in got)
    with pytest.raises(Exception, match="missing"):
        spark.sql("SELECT * FROM recall(TABLE(SELECT workspace FROM store_rows), 'x', 3)").collect()
    code = spark.createDataFrame([("a", "def f(x):\n    return 1\n\ny = 2"), ("b", "nothing")], "hash string, content string")
    code.createOrReplaceTempView("code_rows")
    got = spark.sql("SELECT * FROM symbol(TABLE(code_rows), 'f', 5)").collect()
    assert [(r.hash, r.definition) for r in got] == [("a", "def f(x):\n    return 1")]


def test_listing_by_tasks(spark, tmp_path):
    for name in ("a/b/c/1.txt", "a/b/2.txt", "a/3.txt", "d/4.txt", "many/x"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(name)
    for i in range(30):
        (tmp_path / "many" / str(i)).write_text("")
    roots = [str(tmp_path / x) for x in ("a", "d", "many", "d/4.txt", "gone")]
    df = spark.createDataFrame([(r,) for r in [*roots, None]], "path string")
    got = {os.path.basename(r.path): (r.mtime, r["size"], r.ctime) for r in listing.signatures(df, most=10).collect()}

    def plain(root):
        every = [root] + [os.path.join(d, n) for d, dirs, files in os.walk(root) for n in dirs + files]
        stats = [os.stat(p) for p in every]
        return max(s.st_mtime_ns / 1e6 for s in stats), len(every) - 1, max(s.st_ctime_ns / 1e6 for s in stats)

    assert got == {"a": plain(roots[0]), "d": plain(roots[1])}
    files = {(r.path, r["size"], r.ctime) for r in listing.snapshot(spark.createDataFrame([(str(tmp_path),)], "path string")).collect()}
    assert files == {(r.path, r["size"], r.ctime) for r in blobs.snapshot(spark, str(tmp_path)).collect()} and len(files) == 35
