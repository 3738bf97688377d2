"""Folds, meters, deltas over versions, views and payloads against straight-line versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from condense.functions import delta, payload, pyudf, rules, text
from condense.operators import convo, meter, search, serve, store
from condense.operators.folds import fold
from condense.sources import blobs as files
from condense.sources import dimensions, logs, meters

NOW = 1_000_000_000_000


def test_fold_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k, i, i % 5) for k in ("a", "b", None) for i in range(50)], "k string, i int, v int").repartition(3)
        out = fold(rows, "k", ["i"], ["i", "v"], int, lambda s, r: (s + r[1], (r[0], s + r[1]) if r[0] % 10 == 9 else None), "i int, total bigint", lambda s: (-1, s)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r.k), r.i, r.total) for r in out) == sorted((k, i, t) for k in ("a", "b", "None") for i, t in ((9, 20), (19, 40), (29, 60), (39, 80), (49, 100), (-1, 100)))


def test_epochs_and_breaker_against_loops(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([5_000, 30_000, 60_000, 90_000]), rng.random() < 0.5) for k in "abc" for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, size bigint, failed boolean")
    want, states = {}, {}
    for k in "abc":
        peak = epoch = 0
        state, failures, turns, opened = "closed", 0, 0, 0
        for _, i, n, bad in (r for r in rows if r[0] == k):
            if n < peak * 0.9 and peak - n > 20_000:
                peak, epoch = n, epoch + 1
            peak = max(peak, n)
            want[k, i] = epoch
            if state == "open":
                turns += 1
                if turns >= 5:
                    state, turns = "half-open", 0
            elif bad:
                failures += 1
                if state == "half-open" or failures >= 3:
                    state, turns, opened = "open", 0, opened + 1
            else:
                state, failures, turns = "closed", 0, 0
        states[k] = (state, failures, opened)
    assert {(r.conv_id, r.turn): r.epoch for r in convo.epochs(df).collect()} == want and max(want.values()) > 2
    assert {r.conv_id: (r.state, r.failures, r.opened) for r in convo.breaker(df, "conv_id", "turn", "failed").collect()} == states


def test_calibrate(spark):
    rng = random.Random(2)
    rows = [("fit", i, a := rng.randrange(100, 4000), 0, a // 4 + 7) for i in range(260)] + [("few", i, 400, 0, 100) for i in range(3)]
    rows += [("falls", i, 100 * (10 - i), 0, 50 + 10 * i) for i in range(8)] + [("none", 0, 0, 0, 5)]
    out = {r.k: r for r in meter.calibrate(spark.createDataFrame(rows, "k string, i int, ascii bigint, cjk bigint, tokens bigint"), "k", "i").collect()}
    assert set(out) == {"fit", "few", "falls"} and out["fit"].samples == 260 and out["fit"].fitted == 200
    assert abs(out["fit"].chars_per_token - 4) < 0.05 and out["few"].chars_per_token == 4 and out["few"].fitted is None
    mean = 0.0
    for n, (_, i, a, _, t) in enumerate(r for r in rows if r[0] == "falls"):
        mean += (a / t - mean) / min(n + 1, 32)
    assert abs(out["falls"].chars_per_token - mean) < 1e-9  # a falling line has no use


def test_commitment_meter(spark):
    rows = [(i, i % 3, i % 2, [f"k:{i}-{j}" for j in range(i % 6)]) for i in range(30)]
    r = meter.commitment_meter(spark.createDataFrame(rows, "at int, total int, preserved int, missed array<string>")).first()
    some = [x for x in rows if x[1] > 0]
    samples = [(x[0], j, m) for x in some for j, m in enumerate(x[3][:3])][-20:]
    assert (r.checks, r.atoms, r.preserved, r.missed) == (len(some), sum(x[1] for x in some), sum(x[2] for x in some), sum(len(x[3]) for x in some))
    assert [tuple(s) for s in r.samples] == samples
    none = meter.commitment_meter(spark.createDataFrame([], "at int, total int, preserved int, missed array<string>")).first()
    assert (none.checks, none.missed) == (0, 0)


def test_dimension_bound(spark):
    names = spark.range(50).select(F.col("id").cast("string").alias("model"))
    assert meter.bounded(names, 50).count() == 50
    with pytest.raises(Exception, match="more than 49 rows"):
        meter.bounded(names, 49).collect()


def test_payloads(spark):
    u = {"usage": 1, "prompt_tokens": 12, "completion_tokens": "9", "outputTokens": 4, "prompt_tokens_details": {"cached_tokens": 3}}
    p = {"playbook": [{"path": "/a", "helpful": 2, "ref": 5, "stale": True}, {"path": ""}, {"helpful": 1}, 7, {"path": "/b", "helpful": "x", "harmful": 1.0, "lastAt": 9, "ref": "r", "stale": "yes"}]}
    df = spark.createDataFrame([(json.dumps(u), json.dumps(p), {"a": "x" * 300}), ("no json", "[]", None)], "u string, p string, i map<string,string>")
    a, b = df.select(payload.usage("u").alias("u"), payload.playbook_entries("p").alias("p"), payload.pruned_input("i").alias("i")).collect()
    assert tuple(a.u) == (12, 4, 3) and tuple(b.u) == (0, 0, 0) and len(a.i) == 200 and b.i is None
    assert [tuple(e) for e in a.p] == [("/a", None, 2, 0, 0, True), ("/b", "r", 0, 1, 9, False)] and not b.p


def test_observations_and_views(spark):
    block = "struct<type:string,text:string,content:string,is_error:boolean>"
    rows = [
        ("c", 1, "tool", "out", False, None), ("c", 2, "tool", "", False, None), ("c", 3, "tool", "summary", True, None),
        ("c", 4, "user", None, False, [("tool_result", None, "res", True), ("text", "hi", None, None), ("tool_result", "t", None, None), ("tool_result", None, "", None)]), ("c", 5, "assistant", "x", None, None),
    ]
    m = spark.createDataFrame(rows, f"conv_id string, turn int, role string, content string, is_summary boolean, blocks array<{block}>")
    assert sorted((r.turn, r.block, r.text, r.is_error) for r in convo.collect_observations(m).collect() if r.block is not None) == [(4, 0, "res", True), (4, 2, "t", False)]
    assert [(r.turn, r.text) for r in convo.collect_observations(m).collect() if r.block is None] == [(1, "out")]

    blobs = spark.createDataFrame([("h1", 0, 5, "text", "one\ntwo"), ("h2", 1, 9, "binary", None), ("h3", 2, 1 << 21, "text", "big"), ("h4", 3, 3, "text", "x")], "hash string, seq bigint, size bigint, kind string, content string")
    calls = spark.createDataFrame([("s", i, "read", "in", f"h{i}") for i in (1, 4, 9)] + [("t", 1, "grep", "abc", "h1")], "session string, seq int, tool string, input string, hash string")
    got = {(r.session, r.part, r.seq): r.line for r in convo.view_parts(calls, blobs, warm=2, entries=3).collect()}
    assert got == {
        ("s", "warm", 4): "# tool: read\nx", ("s", "ref", 9): "[blob:h9:2]", ("t", "warm", 1): "# tool: grep\none\ntwo",
        (None, "toc", 0): "  h1 5 chars one", (None, "toc", 2): "  h3 2097152 chars big", (None, "ref", 1): "[binary of 9 bytes left out]", (None, "ref", 2): "[large text of 2097152 bytes left out]",
    }


def test_shortened_view(spark):
    code = "function f(a) {\n  let x = 1\n\tx += 2\n\treturn x\n}"
    view = f"prose here\n{code}\nmore prose\nconst a = 1\nend"
    assert pyudf.shortened_code_of(view) == f"prose here\n{pyudf.skeleton_of(code)}\nmore prose\nconst a = 1\nend" and len(pyudf.skeleton_of(code)) < len(code)
    df = spark.createDataFrame([(view,), ("word " * 2000,), ("",), (None,)], "v string")
    out = [r[0] for r in df.select(convo.shorten_view("v", 500)).collect()]
    assert out[0] == pyudf.shortened_code_of(view) and out[2] == "" and out[3] is None
    assert out[1] == ("word " * 2000)[:int(500 * 3.3 * 0.9)] + "\n[view trimmed to token budget]"


def test_state_summary(spark):
    r = spark.createDataFrame([("plan", "  ")], "a string, b string").select(convo.state_summary({"Active Plan": F.col("a"), "Skills Invoked": F.col("b")})).first()[0]
    lines = r.split("\n")
    assert len(lines) == 22 and lines[:2] == ["## Active Plan", "plan"] and lines[2:4] == ["## Current Phase", "(not verified)"] and r.count("(not verified)") == 10


def test_json_skeleton(spark):
    texts = ['{"a": [1, 2], "b": {"c": null, "d": "x"}, "e": [], "f": [null]}', "[true]", "no", '"string"', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.structure(F.col("t"))).collect()]
    assert got == ['{"a":"[number]","b":{"c":"null","d":"string"},"e":"[]","f":"[object]"}', '"[boolean]"', None, None, None]


def test_edit_scripts_are_shortest():
    rng = random.Random(3)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        s = pyudf.edit_script(x, y)
        assert [t for k, t, _, _ in s if k != "add"] == x and [t for k, t, _, _ in s if k != "del"] == y
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                best[i][j] = i + j if not i or not j else best[i - 1][j - 1] if x[i - 1] == y[j - 1] else 1 + min(best[i - 1][j], best[i][j - 1])
        assert sum(k != "same" for k, *_ in s) == best[-1][-1]


def window_of(script, first, limit, total):
    """Changed lines of the new text inside a window, by the script's own line numbers."""
    end = min(first + limit - 1, total)
    return any(k == "add" and first <= n <= end for k, _, _, n in script)


def test_window_deltas(spark):
    old = [f"line {i} of the file with some more text in it" for i in range(1, 201)]
    new = list(old)
    new[49] = "changed"
    new[10:10] = ["added one", "added two"]
    pairs = spark.createDataFrame([("\n".join(old), "\n".join(new))], "old string, new string")
    windows = spark.createDataFrame([(1, 5), (12, 3), (30, 10), (45, 20), (150, 20), (203, 5), (0, 5), (202, 1)], "offset int, limit int")
    d = serve.deltas(pairs).crossJoin(windows)
    out = {(r.offset, r["limit"]): r.w for r in d.withColumn("w", delta.window_delta("hunks", F.lit("/f"), "offset", "limit", F.lit(len(new)), F.lit(len(old)), F.lit("[r]"))).collect()}
    assert out[203, 5] is None and out[0, 5] is None
    assert out[1, 5].kind == "unchanged" and "same lines" in out[1, 5].text and out[30, 10].kind == "unchanged" and "lines 28-37" in out[30, 10].text and "moved by 2" in out[30, 10].text
    assert out[12, 3].kind == "changed" and "+added one" in out[12, 3].text and out[45, 20].kind == "changed" and "-line 50" in out[45, 20].text and "+changed" in out[45, 20].text
    assert out[202, 1].kind == "unchanged" and "lines 200-200" in out[202, 1].text and "full text in store [r]" in out[202, 1].text

    blobs = spark.createDataFrame([("h", "/f", "\n".join(old), True, 1, 1, 1)], "hash string, file_path string, content string, full_file boolean, last_ref bigint, created_at bigint, seq bigint")
    files = spark.createDataFrame([("/f", "\n".join(new)), ("/g", "x")], "path string, content string")
    asked = spark.createDataFrame([("/f", 1, 100), ("/f", 60, 90), ("/f", 900, 5), ("/g", 1, 5), ("/f", 1, 2)], "path string, offset int, limit int")
    got = {(r.path, r.offset, r["limit"]): (r.kind, r.reason) for r in serve.window_deltas(asked, blobs, files).collect()}
    assert got == {("/f", 1, 100): ("changed", None), ("/f", 60, 90): ("unchanged", None), ("/f", 900, 5): (None, "out of bounds"), ("/g", 1, 5): (None, "no prior"), ("/f", 1, 2): (None, "patch not shorter")}
    unsafe = serve.window_deltas(asked, blobs, files, spark.createDataFrame([("other",)], "hash string")).collect()
    assert {r.reason for r in unsafe if r.path == "/f"} == {"not in context"}


def test_reread_deltas_over_versions(spark):
    base = [f"some line {i} that is long enough to be worth a patch" for i in range(60)]
    v = {"h1": base, "h2": base[:50] + ["x"] * 10, "h3": ["other"] * 60, "h4": base[:59] + ["newest"], "h5": base[:30]}
    rows = [(h, "/f", "read_file", "\n".join(t), i, i, i) for i, (h, t) in enumerate(v.items())]
    blobs = spark.createDataFrame(rows, "hash string, file_path string, source string, content string, last_ref bigint, created_at bigint, seq bigint")
    reads = spark.createDataFrame([(1, "/f", "\n".join(base[:58] + ["a", "b"])), (2, "/g", "x"), (3, "/f", "\n".join(["unlike"] * 60))], "read_id int, path string, content string")
    got = {r.read_id: r for r in serve.reread_deltas(reads, blobs).collect()}
    assert (got[1].decision, got[1].hash) == ("delta", "h4") and "+a" in got[1].patch and got[1].reason is None
    assert (got[2].decision, got[2].reason) == ("full", "no prior") and (got[3].decision, got[3].reason) == ("full", "too different")
    only = {r.read_id: r for r in serve.reread_deltas(reads, blobs, spark.createDataFrame([("h1",), ("h3",)], "hash string")).collect()}
    assert only[1].hash == "h1" and only[3].reason == "not in context"
    assert {r.reason: r.n for r in serve.refusals(serve.reread_deltas(reads, blobs)).collect()} == {None: 1, "no prior": 1, "too different": 1}


def test_stub_safe_remembers_hashes_not_deliveries(spark):
    rows = [("s", i, "a" if i % 10 == 0 else "b", 0) for i in range(40)] + [("s", 40 + i, f"n{i}", 0) for i in range(5)] + [("s", 50, "a", 0), ("s", 51, "b", 1), ("s", 52, "b", 1)]
    df = spark.createDataFrame(rows, "session string, seq int, hash string, epoch int")
    got = {r.seq: r.safe for r in serve.stub_safe(df, newest=4).collect()}
    assert not got[0] and not got[1] and all(got[i] for i in range(2, 40)) and not got[50] and not got[51] and got[52]
    gone = {r.seq: r.safe for r in serve.stub_safe(df, newest=4, evicted=spark.createDataFrame([("a",)], "hash string")).collect()}
    assert not gone[10] and gone[11]


def stored(spark, rows):
    """Rows of the store from dicts of what differs."""
    fields = {"hash": "string", "content": "string", "seq": "bigint", "created_at": "bigint", "last_ref": "bigint", "content_at": "double", "source": "string", "command": "string", "workspace": "string", "file_path": "string", "edited_by_model": "boolean", "full_file": "boolean"}
    fields |= dict.fromkeys(("file_mtime", "file_size", "file_ctime", "dir_mtime", "dir_size", "dir_ctime"), "double")
    full = [tuple(({"seq": i, "created_at": NOW - i, "last_ref": NOW - i, "source": "web_search", "workspace": "w"} | r).get(f) for f in fields) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{f} {t}" for f, t in fields.items()))


def test_recall_keeps_to_its_workspace(spark):
    body = "needle in some text"
    docs = stored(spark, [
        {"hash": "own", "content": body}, {"hash": "other", "content": body, "workspace": "x"}, {"hash": "none", "content": body, "workspace": None},
        {"hash": "edit", "content": body, "source": "edit_file"}, {"hash": "write", "content": body, "source": "write_file"},
        {"hash": "patch", "content": body, "source": "apply_patch"}, {"hash": "create", "content": body, "source": "create_file"}, {"hash": "miss", "content": "nothing"}, {"hash": "empty", "content": None},
    ])
    ids = lambda **k: {r.id for r in search.recall(docs, "needle", now=F.lit(NOW), **k).collect()}
    assert ids(workspace="w") == {"own"} and ids(workspace="x") == {"other"} and ids(workspace=None) == {"none"} == ids(workspace="") and ids(workspace="y") == set()


def test_recall_supersedes_and_cuts_snippets(spark):
    long = "x" * 5000
    docs = stored(spark, [
        {"hash": "new", "content": "needle new", "source": "shell_command", "command": "ls"}, {"hash": "old", "content": "needle old", "source": "shell_command", "command": "ls"},
        {"hash": "mid", "content": f"{long}needle{long}"}, {"hash": "end", "content": f"{long}needle"}, {"hash": "start", "content": f"needle{long}"},
        {"hash": "full", "content": f"{long}needle{long}", "source": "read_file", "file_path": "/f", "full_file": True},
    ])
    got = {r.id: r for r in search.recall(docs, "needle", now=F.lit(NOW), workspace="w", budget=1000).collect()}
    assert got["new"].confidence - got["old"].confidence == 30 and got["new"].snippet == "needle new"
    assert all(len(got[h].snippet) == 1000 and "needle" in got[h].snippet for h in ("mid", "end", "start", "full"))
    assert got["end"].snippet.endswith("needle") and got["start"].snippet.startswith("needle")
    whole = {r.id: r for r in search.recall(docs, "needle", now=F.lit(NOW), workspace="w", budget=1000, full_content=True).collect()}
    assert len(whole["full"].snippet) == 10_006 and len(whole["mid"].snippet) == 1000


def test_tokens_without_making_them(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["abc", "xabc", "abc1", " ", "\n", "_", ".", "/", "\\", "-", ",", "é"]) for _ in range(rng.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", text.fold_ascii(F.lower("t")))
    rows = df.select(search.is_token(F.col("f"), "abc").alias("a"), F.array_contains(text.identifier_tokens("t"), "abc").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and 20 < sum(r.a for r in rows) < 280


def test_recall_through_the_index(spark):
    docs = stored(spark, [{"hash": "a", "content": "alpha here"}, {"hash": "b", "content": "beta and alphabet"}, {"hash": "c", "content": "gamma"}])
    index = search.postings(docs)
    ids = lambda q: {r.id for r in search.recall(docs, q, now=F.lit(NOW), workspace="w", index=index).collect()}
    assert ids("alpha nothing") == {"a"}  # b has no such token
    assert ids("alph xyz") == {"a", "b"}  # the index knows none of the words, so all are read
    assert ids("alpha") == {"a", "b"}


def test_folder_proof(spark):
    docs = stored(spark, [{"hash": h, "content": "t", "source": "shell_command", "command": f"ls {h}", "file_path": f"/d/{h}", "dir_mtime": 1.0, "dir_size": 2.0, "dir_ctime": 3.0} for h in ("same", "moved", "gone")])
    folders = spark.createDataFrame([("/d/same", 1.0, 2, 3.0), ("/d/moved", 5.0, 2, 3.0)], "path string, mtime double, size bigint, ctime double")
    files = spark.createDataFrame([], "path string, mtime double, size bigint, ctime double")
    got = {r.hash: set(r.flags) for r in serve.score(docs, files, F.lit(NOW), "w", folders).collect()}
    assert got["same"] == {"dir unchanged"} and "dir changed" in got["moved"] and "directory deleted" in got["gone"]


def test_upsert_and_supersede(spark):
    s = "hash string, size bigint, created_at bigint, last_ref bigint, kind string, seen bigint"
    a = spark.createDataFrame([("h", 1, 5, 9, "text", 3), ("g", 1, 1, 1, "text", 1)], s)
    b = spark.createDataFrame([("h", 2, 4, 8, "text", 1), ("n", 2, 2, 2, "text", 1)], s)
    assert {r.hash: (r.size, r.created_at, r.last_ref, r.seen) for r in store.upsert(a, b).collect()} == {"h": (1, 4, 9, 4), "g": (1, 1, 1, 1), "n": (2, 2, 2, 1)}
    rows = spark.createDataFrame([("a", "/f", 1.0), ("a", "/f", 2.0), ("b", "/g", 1.0), ("c", "/g", 2.0)], "hash string, file_path string, file_mtime double").withColumn("source", F.lit("read_file"))
    assert sorted((r.hash, r.file_mtime, r.superseded) for r in store.supersede(rows).collect()) == [("a", 1.0, False), ("a", 2.0, False), ("b", 1.0, True), ("c", 2.0, False)]


def test_garbage(spark):
    blobs = spark.createDataFrame([(f"h{i}", 10, i, i, "s") for i in range(10)], "hash string, size bigint, created_at bigint, last_ref bigint, session string")
    contents = spark.createDataFrame([(f"h{i}", "t") for i in range(1, 12)], "hash string, content string")
    left, texts = store.collect_garbage(blobs, contents, F.lit(NOW), cap_bytes=50, cap_blobs=0)
    assert sorted(r.hash for r in left.collect()) == [f"h{i}" for i in range(5, 10)] == sorted(r.hash for r in texts.collect())


def test_sources_of_small_files(spark, tmp_path):
    contents = spark.createDataFrame([("a", "xx", 1), ("b", "y", 2)], "hash string, content string, created_at bigint")
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "hash string")
    assert sorted(tuple(r) for r in files.exists(contents, asked).collect()) == [("a", True), ("z", False)]
    assert [r.hash for r in files.without(contents, asked).collect()] == ["b"] and sorted(r["size"] for r in files.listing(contents).collect()) == [1, 2]
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text(name)
    read = files.read_files(spark, str(tmp_path / "*.txt")).cache()
    assert read.count() == 2
    (tmp_path / "two.txt").write_text("longer now")
    assert [r.content for r in files.consistent(read, files.listed_files(spark, str(tmp_path / "*.txt"))).collect()] == ["one.txt"]
    m = str(tmp_path / "metrics")
    assert tuple(meters.load(spark, m, ["hits", "misses"]).first()) == (0.0, 0.0)
    meters.save(spark, m, {"hits": 3})
    meters.save(spark, m, {"hits": 4})
    assert tuple(meters.load(spark, m, ["hits", "misses"]).first()) == (4.0, 0.0)
    p = str(tmp_path / "purged")
    rows = spark.createDataFrame([("o", 5), ("n", 50)], "hash string, created_at bigint")
    assert store.after_purge(rows, meters.purges(spark, p)).count() == 2
    meters.mark_purged(spark, p, 10)
    meters.mark_purged(spark, p, 7)
    assert [r.hash for r in store.after_purge(rows, meters.purges(spark, p)).collect()] == ["n"]


def test_logs_are_pruned(spark, tmp_path):
    import os

    for name, age in (("old.jsonl", 40), ("new.jsonl", 1)):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / name).write_text("{}\n")
        at = (tmp_path / "log" / name).stat().st_mtime - age * 86_400
        os.utime(tmp_path / "log" / name, (at, at))
    assert logs.prune(spark, str(tmp_path / "log"), 30) == 1 and [f.name for f in (tmp_path / "log").glob("*.jsonl")] == ["new.jsonl"]
    logs.clear(spark, str(tmp_path / "log"))
    assert not (tmp_path / "log").exists()


def test_prices_of_some_models(spark, tmp_path):
    data = [{"id": f"{p}/{m}", "pricing": {"prompt": "0.000001", "completion": "0.000002"}} for p, m in (("a", "One"), ("b", "two"), ("b", "three"))]
    (tmp_path / "p.json").write_text(json.dumps({"data": data}))
    ids = lambda only: sorted(r.id for r in dimensions.prices_json(spark, str(tmp_path / "p.json"), only).collect())
    assert ids(None) == ["a/One", "b/three", "b/two"] and ids(["one", "x/TWO"]) == ["a/One", "b/two"] and ids([]) == []


def test_fold_is_exact(spark):
    """Keys, orders and values beyond 2**53 beside nulls."""
    big = 2**53
    rows = [(k, None if i == 0 else big + i, None if i % 3 == 0 else big + i) for k in (None, big, big + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v bigint")
    out = fold(df, "k", ["i"], ["i", "v"], list, lambda s, r: ([*s, r], None), "n bigint, first bigint, top bigint, nulls bigint", lambda s: (len(s), s[0][0], max(v for _, v in s if v), sum(v is None for _, v in s)))
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {k: (40, None, big + 38, 14) for k in (None, big, big + 1)}
