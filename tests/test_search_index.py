"""Recall as queries are written, trigrams for patterns, block maxima."""

import random
import re

import pytest
from pyspark.sql import functions as F

from condense.operators import impacts, search, store, trigrams

NOW = 1_750_000_000_000


def outputs(spark, texts, workspaces=None):
    rows = [(f"h{i}", t, i, NOW - i * 1000, NOW - i * 1000, "web_fetch", f"c{i}", (workspaces or ["w"] * len(texts))[i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "hash string, content string, seq bigint, created_at bigint, last_ref bigint, source string, command string, workspace string")
    return df.select("*", *(F.lit(None).cast("double").alias(x) for x in ("file_mtime", "file_size", "file_ctime", "dir_mtime", "dir_size", "dir_ctime", "content_at")), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("boolean").alias("edited_by_model"))


TEXTS = ["error 404 on page", "status v2 ok", "これは日本語です", "to be or not", "err17 happened", "err happened", "open [x", "CAFÉ closed", None, "", "a.b/c.txt and more", "not found 40"]


@pytest.mark.parametrize(("query", "want"), [
    ("404", {0}), ("日本語", {2}), ("to be", None), ("err[0-9]+", {4}), ("[x", {6}), ("café", {7}), ("  ", set()), ("the 404 v2", None), ("c.txt", {10}),
])
def test_recall_by_own_words(spark, query, want):
    docs = outputs(spark, TEXTS)
    low = [(t or "").lower() for t in TEXTS]
    words = query.lower().split()
    if len(words) > 1:
        want = {i for i, t in enumerate(low) if any(w in t for w in words)}
    ids = lambda **extra: {int(r.id[1:]) for r in search.recall(docs, query, 20, F.lit(NOW), "w", **extra).collect()}
    assert ids() == want
    if len(words) > 1:
        some = {i for i, t in enumerate(low) if set(t.split()) & set(words)}
        assert ids(index=search.postings(docs.where("content is not null"))) == (want & some if some else want)
    elif words:
        assert ids(grams=trigrams.postings(docs)) == want


def test_recall_counts_its_own_workspace(spark):
    """Another workspace's texts change neither scores nor order."""
    texts = [f"needle {'pin ' * (i % 4)} {i}" for i in range(30)]
    alone = outputs(spark, texts)
    both = outputs(spark, texts + ["needle"] * 200, ["w"] * 30 + ["other"] * 200)
    key = lambda df: [(r.id, r.relevance, r.rrf) for r in df.orderBy(F.desc("rrf"), "id").collect()]
    want = key(search.recall(alone, "needle pin", 10, F.lit(NOW), "w"))
    assert key(search.recall(both, "needle pin", 10, F.lit(NOW), "w")) == want
    assert key(search.recall(both, "needle pin", 10, F.lit(NOW), "w", index=search.postings(both))) == want


def test_touch_and_meter(spark):
    docs = outputs(spark, ["needle", "hay", "needle too"])
    out = search.recall(docs, "needle", 5, F.lit(NOW), "w")
    m = search.recall_meter(out).first()
    assert (m.served, m.dropped, m.injected) == (2, 0, len("needle") + len("needle too"))
    later = {r.hash: r.last_ref for r in store.touch(docs, out, F.lit(NOW + 5)).collect()}
    assert later == {"h0": NOW + 5, "h1": NOW - 1000, "h2": NOW + 5}
    assert store.touch(docs, search.recall(docs, " ", 5, F.lit(NOW), "w"), F.lit(NOW + 5)).where(F.col("last_ref") > NOW).count() == 0


def random_pattern(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.45:
        return "".join(rng.choices("abcAé", k=rng.randrange(1, 5)))
    if kind < 0.6:
        return random_pattern(rng, depth + 1) + random_pattern(rng, depth + 1)
    if kind < 0.75:
        return f"({random_pattern(rng, depth + 1)}|{random_pattern(rng, depth + 1)})"
    if kind < 0.85:
        return f"(?:{random_pattern(rng, depth + 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '{2,}', '+?'])}"
    return rng.choice(["[ab]", "[a-c]", ".", "[^a]", r"\w", r"\d", "b$", "^a", r"\bab", "(?=a)", r"\.", "(?i:ab)"])


def holds(q, have):
    if q is True:
        return True
    if isinstance(q, tuple):
        return (all if q[0] == "and" else any)(holds(x, have) for x in q[1])
    return q in have


def test_trigram_queries_rule_out_no_match():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcABC.é ", k=rng.randrange(0, 40))) for _ in range(150)]
    have = [set(trigrams.grams_of(t.encode())) for t in texts]
    narrowed = 0
    for _ in range(1500):
        pattern = random_pattern(rng)
        q = trigrams.needs(pattern)
        assert len(trigrams.listed(q)) <= trigrams.MOST_GRAMS
        found = re.compile(pattern, re.I)
        for t, own in zip(texts, have, strict=True):
            if found.search(t):
                assert holds(q, own), (pattern, q, t)
        narrowed += q is not True
    assert narrowed > 300


def test_trigram_queries_are_sharp():
    g = lambda s: trigrams.grams_of(s.encode())
    assert trigrams.needs("licen[cs]e")[0] == "or" and set(trigrams.listed(trigrams.needs("licen[cs]e"))) == set(g("license") + g("licence"))
    assert set(trigrams.listed(trigrams.needs("error: .*timeout"))) == set(g("error: ") + g("timeout"))
    assert set(trigrams.listed(trigrams.needs("(foo)+bar"))) >= set(g("foobar"))
    for blunt in ("a.b", "[a-z]+", "x*abc|d", r"\x41bc", "[a&&b]cde", r"a\1", "(?x)abc d", "é+"):
        assert trigrams.needs(blunt) is True or blunt == "x*abc|d"


def test_trigram_search(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["ab", "bc", "ca", "AB", "é", "K", "ſ", " "], k=rng.randrange(0, 20))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "hash bigint, content string").repartition(3)
    index = trigrams.sorted_by_gram(trigrams.postings(docs))
    for pattern in ("abca", "(abc|bca)é", "b+cabc?", "kab", "sbc", "É[ab]+b", "ab.*ca", "zzz"):
        want = {r.hash for r in docs.where(F.col("content").rlike("(?iu)" + pattern)).collect()}
        assert {r.hash for r in trigrams.search(docs, index, pattern).collect()} == want
    only = trigrams.candidates(index, "abcabc")
    assert 0 < only.count() < 150 and trigrams.candidates(index, "a.c") is None
    assert trigrams.postings(docs.limit(0)).count() == 0


def test_block_maxima_skip_blocks(spark):
    """Exact top k while most blocks are not read."""
    rng = random.Random(9)
    rows = [(i, " ".join(["Rare"] * (i % 97 == 0) * rng.randrange(1, 5) + ["common"] * rng.randrange(0, 5) + ["x"] * rng.randrange(3))) for i in range(3000)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "hash bigint, content string")
    index = impacts.block_postings(docs, 150).cache()
    terms = ["rare", "common", "absent"]
    n = len(rows)
    of = impacts.weights(index, terms, n)
    plain = sorted(((round(sum(min(3, (t or "").lower().split().count(w)) * of[w] for w in terms), 9), -i) for i, t in rows), reverse=True)
    for k in (1, 10, 40):
        got = [(r.score, -r.id) for r in impacts.top_k(index, terms, k, n).collect()]
        assert [i for _, i in got] == [i for _, i in plain[:k]] and all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(got, plain, strict=False))
    assert impacts.reaching(index, of, 10).count() < 40 < impacts.bounds(index, of).count()
    assert impacts.top_k(index, ["absent"], 5, n).count() == 0
    assert impacts.top_k(index.limit(0), ["rare"], 5, n).count() == 0
    index.unpersist()


def test_texts_in_one_row_group_are_dealt_out(spark, tmp_path):
    from condense.plans import catalog

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("en").alias("lang"))
    one = rows.select("doc_id", F.repeat("text", 40).alias("text"), "lang").coalesce(1)
    one.write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # many splits, of which one holds the row group
    try:
        plain = spark.read.parquet(str(tmp_path / "documents.parquet"))
        used = lambda df: df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert plain.rdd.getNumPartitions() >= 2 and len(used(plain)) == 1
        dealt = used(catalog.table(spark, str(tmp_path), "documents"))
        assert len(dealt) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in dealt) < 1500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
