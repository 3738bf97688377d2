"""Pages, vectors, the registered queries and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from condense.llm import bpe, langid, lines, topk, warc
from condense.llm import queries as q

from brute import brute_repeats, brute_rich_lines, check_packed, groups, longest_parse


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, sf, duck, same, name):
    same(q.QUERIES[name](spark, sf), duck.execute(q.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", ["op3_language", "op7_bpe", "op9_quality"])
def test_one_row_a_document(spark, sf, name):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = q.QUERIES[name](spark, sf)
    assert out.count() == n and out.select("doc_id").distinct().count() == n


def test_warc(spark):
    rng = random.Random(1)
    long = ["<p>" + "x" * 1200 + "</p>", "é" * 600, "y" * 999]
    rows = [(i, f"http://h/{i}", rng.choice([None, "", "small", *long])) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit("clash"))
    out = {r.page_id: r for r in warc.read(warc.write(pages)).collect()}
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = i
    assert len(out) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        kept = last.get(h, i)
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (out[i].record_type, out[i].refers_to) == (("response", None) if kept == i else ("revisit", kept))


def test_warc_odd_rows(spark):
    """No page id, repeated ids and rows, an empty table, urls with line breaks, archives that roll over."""
    long = "<p>" + "z" * 1500
    rows = [(None, "http://h/0", long), (1, "http://h\r\nX: y/1", long), (1, "http://h/1b", long), (2, None, long), (2, None, long), (3, "", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash")).repartition(2)
    files = warc.write(pages, most_bytes=200)
    assert files.count() >= 4 and files.agg(F.sum("records")).first()[0] == len(rows)
    out = warc.read(files).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in out)
    n = len(long)
    assert got == sorted([(-1, n, "revisit", 2), (1, n, "revisit", 2), (1, n, "revisit", 2), (2, n, "response", -1), (2, n, "response", -1), (3, 0, "response", -1), (-1, 0, "response", -1)])
    assert {r.url for r in out if r.page_id == 1} == {"http://h X: y/1", "http://h/1b"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.normal(size=(300, 16)) * rng.choice([0.1, 1, 30], (300, 1))] + [[0.0] * 16] * 3 + [[0.5] * 16] * 4
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1050, [float("nan")] * 16), (1100, [1.0] * 15 + [None])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    got = {}
    for r in topk.top_k(v, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = np.floor(256 * np.asarray(vectors)).astype(np.int64)
    queries = [i for i in range(len(vectors)) if i % 50 == 0]
    assert set(got) == set(queries)
    for i in queries:
        s = x @ x[i]
        best = sorted((j for j in range(len(vectors)) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [got[i][n + 1] for n in range(5)] == [(j, int(s[j])) for j in best]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def brute_topk(rows, k=5, every=50):
    own = {i: [int(x // 1) if abs(x) < 2**53 else int(x) for x in (256 * float(y) for y in v)] for i, v in rows}
    out = {}
    for i, v in own.items():
        if i % every == 0:
            s = {j: sum(a * b for a, b in zip(v, w, strict=True)) for j, w in own.items() if j != i and len(w) == len(v)}
            out[i] = [(j, s[j]) for j in sorted(s, key=lambda j: (-s[j], j))[:k]]
    return {i: x for i, x in out.items() if x}


def found(df, every=50):
    got = {}
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"), F.lit(1).alias("dim"), F.lit(2).alias("block"))
    for r in topk.top_k(v, F.col("vec_id") % every == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def test_topk_odd_vectors(spark):
    """Huge components, two dimensions, ties, fewer candidates than k, negative scores."""
    schema = "vec_id bigint, embedding array<double>"
    rows = [(0, [1e9] * 8), (1, [0.1] * 8), (2, [-1e9] * 8), (50, [1e5, -1e5] * 4), (3, [1.0, 2.0]), (100, [-1.0, 0.5]), (4, [0.0, 0.0]), (150, [1e15, 1.0, 0.0]), (7, [0.1, -5.0, 1.0])]
    rows = [r for r in rows if r[0] not in (0, 2)] + [(0, [1e6] * 8), (2, [-1e6] * 8)]
    assert found(spark.createDataFrame(rows, schema)) == brute_topk(rows)
    huge = [(0, [1e18, 0.0]), (1, [0.0, 3.0]), (2, [0.01, 1.0]), (3, [-0.01, 1.0])]  # components beyond a long, products within
    assert found(spark.createDataFrame([r for r in huge if r[0] < 2], schema)) == brute_topk([r for r in huge if r[0] < 2])
    with pytest.raises(Exception, match="no 64-bit integer"):
        found(spark.createDataFrame([(0, [1e9] * 8), (1, [1e9] * 8)], schema))
    with pytest.raises(Exception, match="no 64-bit integer"):
        found(spark.createDataFrame(huge[:1] + [(1, [1.0, 0.0])], schema))


def test_topk_prunes_before_buckets_are_sent(spark, monkeypatch):
    """Many buckets of falling length: all results, with few pairs of blocks and runs."""
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "RUN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (v / np.linalg.norm(v) * 0.985**i * 50).tolist()) for i, v in enumerate(rng.normal(size=(600, 6)))]
    rows = [(i, v) for i, v in rows if i % 50 or i < 100] + [(10_000 + i, [1.0] * 6) for i in range(90)]
    seen, stored = {}, topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    assert found(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")) == brute_topk(rows)
    runs = seen["topk-places"].count() // 2
    assert seen["topk-pairs"].count() < seen["topk-queries"].count() * runs


def test_pipeline(spark, sf):
    """Stages on planted documents: what is clean stays whole, copies and repeats go."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = " ".join(f"thing{i} the of and to in" for i in range(60))
    near = clean.replace("thing30", "other")
    own = [(10**6, clean), (10**6 + 1, near), (10**6 + 2, clean), (10**6 + 3, "漢字" * 50), (10**6 + 4, None)]
    more = spark.createDataFrame([(i, t, None, "src", len(t or "")) for i, t in own], docs.schema)
    d = docs.unionByName(more).cache()
    out = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == d.columns, name
        out = out.cache()
        if name == "language":
            assert {r.doc_id for r in out.where("doc_id >= 1000000").collect()} == {10**6, 10**6 + 1, 10**6 + 2}
            kept = out.join(d.where("n_chars > 200 and lang is not null"), "doc_id").count() / d.where("n_chars > 200 and lang is not null").count()
            assert kept > 0.95
    left = {r.doc_id: r for r in out.where("doc_id >= 1000000").collect()}
    assert set(left) == {10**6} and left[10**6].text == clean and left[10**6].n_chars == len(clean)
    packed = corpus_pipeline.packed(spark, out, sf)
    assert packed.select("doc_id").distinct().count() == out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "substring_dedup", "packing"]


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    """All five stages by :func:`corpus_pipeline.run` over a small table, each against plain Python on what
    the one before it has kept."""
    rng = random.Random(16)
    words = {l: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(80)] for l, a in (("x", "abcdef"), ("y", "cdefghé"))}
    some = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    passage = some("x", 30)
    texts = [(some(l, rng.randrange(20, 90)), l) for l in "xyxyxy" * 6]
    texts += [("\n".join([some("x", 9), passage, rng.choice(["short", "line two"]), some("x", 9)]), None) for _ in range(6)]
    texts += [(f"{some('y', 12)} {passage} {some('y', 5)}", None) for _ in range(4)] + [(texts[0][0] + " zz", "x"), (texts[3][0], "y"), (texts[3][0], None)]
    texts += [(None, "x"), ("", None), ("123 !!", None), ("漢字" * 40, None), ("\n\n", None)]
    rows = [(i, t, l, "s", len(t or "")) for i, (t, l) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t, *_ in rows}

    model = langid.train(docs)
    own = langid.sampled_texts(docs.where("text is not null and lang is not null"), lambda n: langid.SAMPLE_SYMBOLS)
    sample = {l: langid.symbols(t, model["symbols"])[0].tobytes().decode("latin-1") for l, t in own.items()}
    for i, t in list(kept.items()):
        flat = langid.symbols([t or ""], model["symbols"])[0].tobytes().decode("latin-1")
        bits = min(longest_parse(flat, sample[l]) * b / max(1, len(flat)) for l, b in zip(model["langs"], model["bits"], strict=True))
        if not any(c.isalpha() for c in t or "") or bits > corpus_pipeline.MOST_BITS:
            del kept[i]
    assert kept and len(kept) < len(rows)
    after = [dict(kept)]
    kept = {i: t for i, (n, gone, t) in brute_rich_lines(kept, lines.LEAST_WORDS).items() if gone == 0 or gone < n}
    after.append(dict(kept))
    ids = sorted(kept)
    kept = {i: kept[i] for i, first in zip(ids, groups([kept[i] for i in ids]), strict=True) if ids[first] == i}
    after.append(dict(kept))
    cut = brute_repeats(kept)
    kept = {i: t if not cut[i][1] else cut[i][2].decode() for i, t in kept.items() if not cut[i][1] or cut[i][1] < cut[i][0]}
    after.append(dict(kept))
    assert all(a != b for a, b in zip(after, after[1:], strict=False))  # each stage has had something to do

    d = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, after, strict=False):
        d = stage(spark, d, sf)
        got = d.collect()
        assert {r.doc_id: r.text for r in got} == want, name
        assert all(r.n_chars == len(r.text) for r in got), name
    tokenizer = bpe.tokenizer(q.word_bpe())
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in kept.items()})


def test_empty_corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
    assert d.count() == 0
