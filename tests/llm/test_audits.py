"""Filter audit, source divergence and exact duplicates against plain versions, on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from condense.llm import audit, divergence, exact, spans

SCHEMA = "doc_id bigint, text string, lang string, source string"


def odd_rows(seed=1, n=260):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "été", "Ünder", "x", "日本語", "a#b", "ALLCAPS", "it's", "", " nb", "ﬁ"] + [f"w{i}" for i in range(40)]
    pool = [None, "", " ", "\n\t", "A" * 30, "word " * 150, "é" * 99, "a\x00b", "\x1cq q"]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = rng.choice(pool) if kind < 0.2 else "Same text as others, " * 30 if kind < 0.4 else " ".join(rng.choices(words, k=rng.choice([1, 20, 99, 100, 130, 400])))
        if rng.random() < 0.1 and text:
            text = text.upper()
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s2", "s3", None])))
    rows += [(None, "no id", "en", "s1"), (None, "no id", "en", "s1"), (7, rows[7][1], "fr", "s2"), (7, rows[7][1], "fr", "s2"), (-5, "no id", "xx", "only")]
    rows.append((1000, "long " * 4000 + "Ä# " + " ".join(f"t{i % 977}" for i in range(9000)), "en", "s9"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture
def docs(spark, rows):
    own = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("id", "part", "sha", "entry", "n", "v", "value", "rank", "failed", "term"):
        own = own.withColumn(name, F.lit("clash"))
    return own


def words_of(text):
    return re.findall("[^ \t-\r]+", text or "")


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None and i < first.get(t or "", i + 1):
            first[t or ""] = i
    marks = defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        marks[i] = [max(marks[i][0], q == 1), max(marks[i][1], x == 1)]
    per = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = words_of(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        per[lang or ""].append(({k for k, v in bad.items() if v}, *(marks[i] if i is not None else (0, 0))))
    out, total = {}, Counter()
    for part, docs in per.items():
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                own = [d for d in docs if f in d[0] and not d[0] & gone]
                after = gone | {f}
                total[part, f] += len(own)
                out[part, "".join(order), step] = [
                    sum(not d[0] & after for d in docs), len(own), sum(f in d[0] and bool(d[0] & gone) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in own), sum(d[2] for d in own),
                ]
                gone = after
    return {k: tuple([*v, total[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def test_distinct_of_long_rows(rows, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK_BYTES", 100)
    for t in ((t or "").encode() for _, t, *_ in rows):
        assert audit._distinct_of_long(np.frombuffer(t, "u1")) == (len(t.split()), len(set(t.split())))


def test_filter_audit(spark, docs, rows):
    labels = [(i, i % 3, i % 2) for i in range(0, 280, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (4, None, None)]
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(9))
    out = audit.filter_audit(docs, marked).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    want = brute_audit(rows, [x for x in labels if x[0] is not None])
    assert len(out) == len(want) and got == want
    assert audit.filter_audit(docs.limit(0), marked).count() == 0


def test_spans_verify_hashes():
    data = np.frombuffer(b"aa bb aa cc bb aa", "u1")
    member = spans.byte_class((97, 122))
    first, size, row = spans.spans(data, np.array([9, 0, 8]), member)
    assert [bytes(data[a:a + n]) for a, n in zip(first, size, strict=True)] == [b"aa", b"bb", b"aa", b"cc", b"bb", b"aa"] and row.tolist() == [0, 0, 0, 2, 2, 2]
    for h in (None, np.zeros(6, np.uint64)):  # all hashes alike: words are still told apart
        order, new = spans.classes(data, first, size, h=h)
        assert new.sum() == 3 and len({bytes(data[first[i]:first[i] + 2]) for i in order[new]}) == 3
    assert b"".join(x.tobytes() for x in spans.segments(data, member, 2)) == data.tobytes()
    assert all(x.tobytes().strip() in (b"aa", b"bb", b"cc") for x in spans.segments(data, member, 2))


def brute_divergence(rows, least=10):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = {}
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (n[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 2) // (sum(n.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[x][t]) for t in kept), x) for x in sources if x != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 1 << 30), ("term", terms, 10)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if rank <= most:
                        out[lang, s, part, item] = (value, rank)
    return out


def found(df):
    out = df.collect()
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in out}
    assert len(got) == len(out)
    return got


def test_divergence(docs, rows):
    want = brute_divergence(rows)
    assert found(divergence.source_divergence(docs)) == want and any(k[2] == "term" for k in want)
    none = brute_divergence(rows, 10_000)
    assert found(divergence.source_divergence(docs, least_docs=10_000)) == none and {v[0] for v in none.values()} == {0}
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_in_blocks(spark, rows):
    """Tasks that see a term's run in many batches, and tables of pairs and counts cut to pieces, add up alike."""
    import pyarrow as pa

    rng, sources = random.Random(3), [f"s{i}" for i in range(7)]
    rows = [(i, " ".join(rng.choices([f"t{chr(97 + k)}" for k in range(26)], k=30)), "en", rng.choice(sources)) for i in range(200)]
    partial = divergence.block_counts(spark.createDataFrame(rows, SCHEMA).selectExpr("lang", "source", "cast(text as binary) text").repartition(6))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        terms = divergence.kept_terms(partial)
        got = {(r.term, r.source): r.n for r in terms.collect()}
        want = Counter((t, s) for _, text, _, s in rows for t in text.split())
        assert got == dict(want) and terms.where("lead").count() == 26
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = Counter(s for _, text, _, s in rows for _ in text.split())
    height, old = 3, divergence.CELLS
    try:
        divergence.CELLS = height * 7
        table = pa.table({"term": [t for t, _ in sorted(want)], "source": [s for _, s in sorted(want)], "n": [want[k] for k in sorted(want)]})
        out = {}
        for block in range(3):
            own = divergence._Language(0, block, "en")
            own.begin(pa.table({"source": sources, "n": [n[s] for s in sources], "v": [26] * 7}))
            for at in range(0, table.num_rows, 5):
                own.add(table.slice(at, 5))
            for b in own.end():
                out.update({(r["source"], r["part"], r["item"]): r["value"] for r in b.to_pylist()})
    finally:
        divergence.CELLS = old
    assert out == {k[1:]: v for k, (v, _) in brute_divergence(rows).items()}


def test_divergence_weights_beyond_long():
    big = np.array([10**13, 0, 5], np.int64)
    assert divergence._weight(big, 3 * 10**13, 4).tolist() == [1 + 10**9 * (c + 2) // (3 * 10**13 + 8) for c in big.tolist()]


def test_exact(spark, docs, rows):
    out = exact.exact_duplicates(docs).collect()
    assert len(out) == len(rows) and set(exact.exact_duplicates(docs).columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    group = defaultdict(list)
    for i, t, *_ in rows:
        group[low(t)].append(i)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in group}
    keep = {t: max((i for i in own if i is not None), default=None) for t, own in group.items()}
    want = Counter((i, keep[low(t)], len(group[low(t)]), sha[low(t)]) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    stays = Counter(r.text_sha256 for r in out if r.kept)
    assert stays == Counter(sha.values())  # one row of each group, also of rows that repeat or have no id
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    exactly = exact.exact_duplicates(docs, fold_case=False)
    assert exactly.where("kept").count() == len({t or "" for _, t, *_ in rows})


def test_exact_owners_spill_and_strings(spark):
    """Tries that are put out after every subtree, ids that are strings, a hot text in every block."""
    rng = random.Random(2)
    rows = [(f"d{i}", rng.choice(["hot " * 50, "hot " * 49 + "hoT ", f"text {i % 40}", "text", "tex", "", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    own = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    both = exact.stored(exact.blocks(own, True, block_bytes=300), "test-blocks")
    kept = exact.owners(both.where("length is not null"), trie_bytes=1)
    got = {r.id: (r.keep_id, r.group_size) for r in both.where("length is null").select("entry", "id").join(kept, "entry").collect()}
    group = defaultdict(list)
    for i, t in rows:
        group[(t or "").lower()].append(i)
    assert got == {i: (max(own), len(own)) for own in group.values() for i in own}
    assert both.where("length is not null").count() > len(group)


def test_trie():
    rng = random.Random(5)
    trie, seen = exact.Trie(), {}
    for _ in range(3000):
        key = bytes(rng.choices(b"ab", k=rng.randrange(0, 12)))
        node = trie.node(key)
        assert node[2] == seen.get(key)
        node[2] = seen[key] = (key, rng.random())
    assert sorted(trie.values()) == sorted(seen.values())
