"""Operators on texts against brute force, with nulls, empty and odd texts, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from condense.llm import bpe, exchange, langid, lines, media, minhash, packing, quality, substrings
from condense.llm import queries as q

from brute import brute_lines, brute_repeats, brute_rich_lines, check_packed, groups, longest_parse, multiset

ODD = [None, "", " ", "\n\n", "a", "naïve café\tΩ 漢字 \U0001f600", "x" * 5000, "<|endoftext|> don't", "é A B c", "\x00\x01"]


def frame(spark, texts, first=0, **more):
    rows = [(first + i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *(f"{k} string" for k in more)]))


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer(q.word_bpe())


def test_bpe_equals_library(spark, tokenizer):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcXYZ 'sé漢\n\t.,!12 ßœ́") for _ in range(rng.randrange(80))) for _ in range(300)]
    for size in (0, 8, 1 << 16):
        out = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts, ids="x", decoded="y"), q.word_bpe(), lexicon_words=size).collect()}
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(out[i].ids, "<u4").tolist() == ids, repr(t)
            assert out[i].decoded.decode() == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame(spark, texts).limit(0), q.word_bpe()).count() == 0


def test_packing(spark, tokenizer):
    texts = ODD + ["word " * n for n in (1, 7, 2047, 2048, 5000, 90_000)] + ["again"] * 40 + ["one two " * 300] * 25
    docs = frame(spark, texts, start="clash", sequence_id="clash").repartition(3)
    check_packed(packing.harmonic_pack(docs, q.word_bpe()).collect(), {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)})
    assert packing.harmonic_pack(frame(spark, ["a"]).limit(0), q.word_bpe()).count() == 0
    twice = packing.harmonic_pack(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id bigint, text string"), q.word_bpe())
    assert twice.groupBy("doc_id").agg(F.sum("length")).orderBy("doc_id").collect() == [(None, 3), (7, 6)]


def test_packing_query(spark, sf, tokenizer):
    """The registered query over its whole table: its ids, little padding, few cuts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids_of = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    bins = check_packed(packing.harmonic_pack(docs, q.word_bpe()).collect(), ids_of)
    whole = sum(len(x) // 2048 for x in ids_of.values())
    rows = q.op6_packing(spark, sf).collect()
    assert len(rows) - whole < 1.6 * len(ids_of) and len(bins) < 20 + sum(map(len, ids_of.values())) / 2048
    for r in rows:
        own = ids_of[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())


def test_harmonic_classes():
    """Each bin of class k < K gets k remainders of its class before it takes from others."""
    rng = random.Random(7)
    packer, rest = packing.Packer(0, 2048, 16), {}
    for n in (rng.choice((rng.randrange(1, 2048), rng.randrange(1, 300), 2048, 5000)) for _ in range(4000)):
        left = n % 2048
        for start, length, own, offset in packer.add(n):
            assert offset + length <= 2048
            if length < 2048:
                if offset == 0:
                    rest[own] = (min(2048 // length, 16), 0, 0)
                k, pieces, filled = rest[own]
                assert offset == filled
                if k < 16 and pieces < k:
                    assert min(2048 // (n - start), 16) == k and start + length == n
                rest[own] = (k, pieces + 1, filled + length)
        assert left >= 0 and len(packer.open()) <= 17
    assert all(filled == 2048 for own, (_, _, filled) in rest.items() if own not in packer.open())


def test_substrings(spark):
    rng = random.Random(2)
    words = ["alpha", "béta", "g", "delta,", "漢"]
    base = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(5)]
    texts = ODD + [" ".join(rng.choice(base) + rng.choice(["", " x"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["same " * 100] * 3 + ["u " * 19, "v " * 20]
    docs = frame(spark, texts, kept="clash", n_words="clash")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(docs).collect()}
    assert got == brute_repeats(dict(enumerate(texts)))
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    twice = substrings.remove_repeats(frame(spark, ["w%d" % i for i in range(3)]).unionAll(frame(spark, ["w%d" % i for i in range(3)])))
    assert twice.count() == 6 and twice.where("n_removed > 0").count() == 0
    assert substrings.remove_repeats(spark.createDataFrame([(None, "a b"), (1, None)], "doc_id bigint, text string")).count() == 2


def test_hot_prefixes_are_lengthened(spark):
    """The same rows for any number of leaves that a prefix may have, also where all are too many."""
    rng = random.Random(12)
    head = " ".join(f"h{i}" for i in range(12))
    texts = [f"{head} {' '.join(rng.choice('xyz') for _ in range(12))} t{i % 7}" for i in range(200)]
    texts += [f"{rng.choice('pq')} {head} a b c d e f g h {rng.choice('rs')} u v" for _ in range(60)] + ["same " * 90] * 2
    docs = frame(spark, texts)
    want = brute_repeats(dict(enumerate(texts)))
    for most in (0, 5, 50, 1 << 20):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(docs, leaves=most).collect()}
        assert got == want
    table = pa.table({"in0": list(range(len(texts))), "in1": [t.encode() for t in texts], "order": [0] * len(texts)})
    chunk = substrings._Chunk(table, "in0", "in1", "order", 20)
    assert chunk.leaves.max() > 50  # a hot prefix indeed
    assert exchange.packed(chunk.prefixes, 1 << 20, 0).num_rows <= chunk.prefixes.size  # never more messages than prefixes


def test_subtrees_against_brute_force():
    rng = np.random.default_rng(13)
    n, length = 400, 8
    prefix = rng.integers(0, 4, n).astype(np.uint64)
    words = rng.integers(1, 3, (n, length)).astype(np.uint64)
    mask = rng.integers(0, 32, n).astype(np.uint64)
    ids, order, place = rng.integers(0, 40, n), rng.integers(0, 3, n), rng.permutation(n).astype(np.uint32)
    got = substrings.later_leaves(prefix, mask, ids, order, place, words, length)
    for o in range(5):
        first = {}
        key = lambda i: (prefix[i], *words[i, :o], "|", *words[i, 4:8 - o])  # noqa: B023, E731
        for i in sorted(range(n), key=lambda i: (ids[i], order[i], place[i])):
            if int(mask[i]) >> o & 1:
                assert (int(got[i]) >> o & 1) == (key(i) in first)
                first.setdefault(key(i), i)
            else:
                assert not int(got[i]) >> o & 1


NAMES = ("in0", "IN1", "hash", "id", "key", "text2", "chunk", "order", "group", "runs", "runs", "n_lines", "n_removed", "kept", "n_words", "lang_pred", "score", "bits", "quality_score", "band", "class_id", "copy", "other", "__hash", "__id", "__text")


def test_columns_of_any_name_stay(spark, sf):
    """Every name that an operator uses inside or for its results, as a column of the caller."""
    texts = ["one two three\nfour\nfive", "one two three\nfour\nfive", " ".join(f"w{i}" for i in range(40)), None, ""]
    rows = [(i, t, "en", *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows).toDF("doc_id", "text", "lang", *NAMES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert got and all(list(r)[3:] == [f"{n}-{r[0]}" for n in NAMES] for r in got), name
    model = quality.train(docs.select("doc_id", "text", F.lit(1).alias("quality")))
    for op, new in (
        (lines.remove_repeated_lines(docs), ["n_lines", "n_removed"]), (substrings.remove_repeats(docs), ["n_words", "n_removed", "kept"]),
        (langid.predict(docs, langid.train(docs)), ["lang_pred", "score", "bits"]), (quality.score(docs, model), ["quality_score"]),
    ):
        assert op.columns == [c for c in docs.columns if c not in new] + new
        got = op.collect()
        assert len(got) == len(texts)
        for r in got:
            assert [v for c, v in zip(op.columns[3:], list(r)[3:], strict=True) if c not in new] == [f"{n}-{r[0]}" for n in NAMES if n not in new]


def test_lines(spark):
    rng = random.Random(3)
    texts = ODD + ["\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(80)] + ["one\ntwo\nthree"] * 3
    docs = frame(spark, texts, n_lines="clash", starts="clash")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_repeated_lines(docs).collect()}
    assert got == brute_lines(dict(enumerate(texts)))
    assert lines.remove_repeated_lines(docs.limit(0)).count() == 0
    p = lines.remove_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p
    longer = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_repeated_lines(docs, run=5).collect()}
    assert longer == brute_lines(dict(enumerate(texts)), 5)


def test_short_runs_by_words(spark):
    """Lines and pairs that repeat between different neighbours, and copies of one or two lines."""
    rng = random.Random(8)
    pool = ["a", "b c", "", "one two  three", "four\tfive six é", "1 2 3 4 5", "six seven eight nine ten eleven"]
    texts = ODD + ["\n".join(rng.choice([*pool, f"own {i}"]) for i in range(rng.randrange(0, 9))) for _ in range(80)] + [pool[-1]] * 3
    docs = frame(spark, texts, runs="clash", words="clash")
    for least in (4, 6):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_repeated_lines(docs, least_words=least).collect()}
        assert got == brute_rich_lines(dict(enumerate(texts)), least)
    p = lines.remove_repeated_lines(docs, least_words=4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p


def test_pipeline_deletes_a_single_repeated_line(spark, sf):
    long = "this work is licensed under the general public license"
    docs = frame(spark, [f"x\n{long}\ny", f"p\n{long}\nq", long, "short line\nr", "short line\ns"])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
    assert got == {0: f"x\n{long}\ny", 1: "p\nq", 3: "short line\nr", 4: "short line\ns"}


def test_signatures_agree_as_weighted_sets_do():
    """The share of equal coordinates approximates the weighted Jaccard similarity."""
    rng = random.Random(17)
    for size, shared, repeats in ((30, 24, 1), (200, 100, 1), (200, 180, 4), (2000, 1200, 1)):
        both = [f"s{i}" for i in range(shared)] * repeats
        texts = [" ".join(both + [f"{side}{i}" for i in range(size - shared)]) for side in "pq"]
        e, n, _ = minhash.shingles([t.encode() for t in texts], words=1)
        a, b = e[:n[0]], e[n[0]:]
        want = minhash.similarity(a, b)
        x, y = (set() for _ in range(2))
        for t, own in zip(texts, (x, y), strict=True):
            seen = {}
            for w in t.split():
                seen[w] = seen.get(w, 0) + 1
                own.add((w, seen[w]))
        assert want == len(x & y) / len(x | y)
        k = 3000
        s = minhash.signatures(e, n, k)
        assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5 + 1e-9, (size, shared)


def test_near_duplicates_of_the_table(spark, sf):
    """The registered query over its whole table against all pairs: no class is missed, none is made up."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    want = [ids[x] for x in groups([texts[i] for i in ids])]
    got = {r.doc_id: r for r in q.op4_near_duplicates(spark, sf).collect()}
    assert [got[i].class_id for i in ids] == want and sum(a != b for a, b in zip(ids, want, strict=True)) > 5
    first = {}
    for i in ids:
        words = " ".join((texts[i] or "").encode().split().__repr__())
        own = first.setdefault(words, i) if (texts[i] or "").split() else i
        assert got[i].representative == own and got[i].n_shingles == len(multiset(texts[i]))


def test_near_duplicates(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        for edits in (0, 0, 1, 1, 2, 3, 8, 14):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    want = groups(texts)
    out = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts, band="x", class_id="y")).collect()}
    assert [out[i].class_id for i in range(len(texts))] == want
    assert minhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0
    copies = minhash.near_duplicates(frame(spark, ["a b c d e f"] * 3 + ["a b"] * 2 + ["a c"])).orderBy("doc_id").collect()
    assert [(r.class_id, r.representative) for r in copies] == [(0, 0)] * 3 + [(3, 3)] * 2 + [(5, 5)]


def test_prefix_filter_loses_no_pair(spark):
    """Every pair of similar sets with different roots comes out, once, and few others."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = base[rng.random(base.size) > 0.12]
        sets.append(np.unique(np.concatenate((own, rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)))))
    df = spark.createDataFrame([(i, i, x.astype("<u8").tobytes()) for i, x in enumerate(sets)], "id bigint, root bigint, e binary")
    got = [(r.a, r.b) for r in minhash.sharing_rare(df, 0.8).collect()]
    want = {(i, j) for j in range(150) for i in range(j) if minhash.similarity(sets[i], sets[j]) >= 0.8}
    assert want and want <= set(got) and len(got) == len(set(got))
    assert minhash.sharing_rare(df.withColumn("root", F.lit(1).cast("bigint")), 0.8).count() == 0


def test_prefixes_are_never_broadcast(spark):
    """Each exploded row carries its set's list: small on disk, many times as large in a broadcast on the driver."""
    x = np.arange(1, 200, dtype="<u8")
    out = minhash.sharing_rare(spark.createDataFrame([(i, i, x.tobytes()) for i in range(4)], "id bigint, root bigint, e binary"), 0.8)
    assert len(out.collect()) == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    out = langid.predict(docs.withColumn("score", F.lit("clash")), model).where("doc_id % 2 = 1 and lang is not null and n_chars > 40").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.9 and all(0 <= r.score <= 1 for r in out)
    odd = langid.predict(frame(spark, [None, "", "12 34!", "...", "x" * 100_000]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:4]] == ["und"] * 4 and odd[4].lang_pred in model["langs"] and odd[0].score == 0
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}


def test_language_learns_from_copies_and_late_text(spark):
    """Texts that all have a copy, a language of near copies, and text behind a long head of digits."""
    rng = random.Random(9)
    vocabulary = {l: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for l, a in (("x", "abcdef"), ("y", "cdefgh"), ("z", "efghij"))}
    some = lambda l, n: " ".join(rng.choice(vocabulary[l]) for _ in range(n))
    base = some("y", 60)
    rows = [(t, "x") for t in (some("x", 80) for _ in range(60)) for _ in range(2)]
    rows += [(f"{base} {i}", "y") for i in range(3000)] + [(some("y", 80), "y") for _ in range(90)]
    rows += [("12 " * 1000 + some("z", 80), "z") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.monotonically_increasing_id())
    learned = langid.sampled_texts(docs, lambda n: langid.SAMPLE_SYMBOLS)
    assert {l: sum(map(len, t)) > 15_000 for l, t in learned.items()} == {"x": True, "y": True, "z": True}
    assert sum(t.startswith(f" {base[:100]}") for t in learned["y"]) == 1
    model = langid.train(docs)
    tests = [(some(l, 30), l) for l in "xyz" for _ in range(50)]
    out = langid.predict(spark.createDataFrame(tests, "text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_parse_against_greedy_search():
    """Counts of one parse from end to end, whatever the blocks: random, periodic, sampled and unknown texts."""
    rng = random.Random(6)
    codes = {c: i for i, c in enumerate("abcd")}
    as_codes = lambda t: np.asarray([codes[c] for c in t], np.uint8)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for sample in (some("abc", 200), "a" * 20, "ab" * 5, some("ab", 3000)):
        machine = langid.automaton(as_codes(sample))
        texts = [some("abcd" if i % 2 else "ab", rng.randrange(2600)) for i in range(30)]
        texts += ["a" * 1500, "ab" * 1300, "d" * 700, sample * 3, ("a" * 19 + "d") * 200, "a" * 513, "b" * 512, ""]
        got = langid.phrases(np.concatenate([as_codes(t) for t in texts]), np.asarray([len(t) for t in texts]), [machine])[:, 0]
        assert got.tolist() == [longest_parse(t, sample) for t in texts]


def test_language_of_many_letters(spark):
    """Scripts of thousands of letters: none is lost, and two languages that share a script are told apart."""
    rng = random.Random(11)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    words = {l: ["".join(rng.choice(letters) for _ in range(2)) for _ in range(600)] for l in "pq"}
    some = lambda l, n: "，".join(rng.choice(words[l]) for _ in range(n))
    docs = spark.createDataFrame([(some(l, 200), l) for l in "pq" for _ in range(60)], "text string, lang string")
    model = langid.train(docs)
    seen = {c for t in docs.collect() for c in t.text if c.isalpha()}
    assert len(seen) > 1500 and all(model["symbols"].place[ord(c)] > 1 for c in seen)
    flat, size, _ = langid.symbols(["".join(sorted(seen)), "ab"], model["symbols"])
    assert size[0] > len(seen) and len({flat[i:i + 3].tobytes() for i in range(3 * 46, int(size[0]) - 3, 3)}) > 1000
    tests = [(some(l, 20), l) for l in "pq" for _ in range(40)] + [("".join(chr(0xAC00 + i) for i in range(300)), None)]
    out = langid.predict(spark.createDataFrame(tests, "text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 79
    assert out[-1].bits > 8 > max(r.bits for r in out[:-1])


def test_language_ties_and_repeats(spark):
    rows = [("the same words in both", l) for l in "ba"]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "the same words in both", "x", 2.0)] * 3 + [(None, None, None, None)], "doc_id bigint, text string, BITS string, score double")
    out = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in out] == ["a"] * 3 + ["und"] and len({(r.score, r.bits) for r in out[:3]}) == 1
    assert langid.predict(docs.limit(0), model).count() == 0


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs.join(labels.where("doc_id % 5 <> 0"), "doc_id"), docs)
    rows = quality.score(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good, bad = ([r.quality_score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.8
    odd = quality.score(frame(spark, ODD * 2, quality_score="clash", in0="own"), model).collect()
    assert len(odd) == 2 * len(ODD) and all(0 <= r.quality_score <= 1 and r.in0 == "own" for r in odd)
    by_text = {}
    for r in odd:
        assert by_text.setdefault(r.text, r.quality_score) == r.quality_score
    none = quality.train(docs.limit(0).withColumn("quality", F.lit(1)))
    assert {r.quality_score for r in quality.score(docs.limit(2), none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def plain_vote(vector, model):
    """Votes of the nearest labelled vectors, one by one; equally near ones by their place."""
    near = sorted((-sum(int(a) * int(b) for a, b in zip(vector, own, strict=True)), i) for i, own in enumerate(model["vectors"]))[:quality.NEIGHBOURS]
    weight = [max(0, -p / quality.GRID**2) ** quality.SHARPNESS * model["weight"][i] + 1e-12 for p, i in near]
    return sum(w * model["labels"][i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight)


def test_quality_votes_against_brute_force(spark):
    """The nearest neighbours of each text by plain Python, with ties among equal labelled texts."""
    rng = random.Random(14)
    some = lambda w, n: " ".join(rng.choice(w) for _ in range(n)) + "."
    good, bad = ["the", "river", "runs", "Slowly", "east,"], ["buy", "$$$", "NOW", "!!!", "click"]
    rows = [(i, some(good if i % 2 else bad, rng.randrange(3, 40)), i % 2) for i in range(120)]
    rows += [(200 + i, "a tie of equal texts", i % 2) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(labelled)
    texts = [some(good + bad, rng.randrange(1, 30)) for _ in range(40)] + ["", "a tie of equal texts"]
    want = [plain_vote(v, model) for v in quality.latent(texts, model)]
    assert np.allclose(quality.vote(texts, model), want, rtol=0, atol=1e-9)
    assert quality.vote(texts[-1:] * 3, model).tolist() == [quality.vote(texts, model)[-1]] * 3
    assert 0.3 < quality.vote(["the river runs NOW"], model)[0] and quality.vote([some(bad, 30)], model)[0] < 0.5 < quality.vote([some(good, 30)], model)[0]
    count = quality.frequencies(labelled)
    alone = (quality.terms([t for _, t, _ in rows], model["table"]) > 0).sum(axis=0)
    assert count[-1] == len(rows) and count[:-1].tolist() == alone.tolist()


def test_words_are_quality_terms(spark):
    """Texts of one shape that differ in their words only are told apart."""
    rng = random.Random(15)
    words = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)] for _ in range(2)]
    some = lambda k: " ".join(rng.choice(words[k]) for _ in range(60))
    model = quality.train(spark.createDataFrame([(i, some(i % 2), i % 2) for i in range(200)], "doc_id bigint, text string, quality int"))
    got = quality.vote([some(i % 2) for i in range(60)], model)
    assert all((x > 0.5) == bool(i % 2) for i, x in enumerate(got))


def test_media(spark, tmp_path):
    texts = ODD + ["y" * 64, "z" * 65, *["twice"] * 9]
    refs = media.write_shards(frame(spark, texts, digest="clash", shard="clash").repartition(4), base=f"file://{tmp_path}/m")
    rows = media.payload_columns(media.header_columns(media.by_object(refs))).collect()
    members = {k: v for p in (tmp_path / "m").iterdir() for k, v in media.members(p.read_bytes()).items()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        full = media.padded(data)
        assert len(full) % 64 == 0 and len(full) >= 64 and (r.n_bytes, r.width * r.height) == (len(data), len(full))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        stored = members[f"{r.digest}.png"]
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 == r.digest and media.from_png(stored) == full
    assert all(r.payload_bytes == r.width * r.height for r in rows)
    places = {}
    for r in rows:  # a digest has one place, whichever task has stored it
        assert places.setdefault(r.digest, (r.shard, r.offset, r.feature)) == (r.shard, r.offset, r.feature)
    assert media.payload_columns(media.header_columns(media.by_object(media.write_shards(frame(spark, texts).limit(0))))).count() == 0
