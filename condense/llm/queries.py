"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, divergence, exact, langid, lines, media, minhash, packing, quality, sampling, substrings, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = media.by_object(media.write_shards(table(spark, sf_dir, "documents")))
    full = media.payload_columns(media.header_columns(refs))
    return full.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature",
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = sampling.fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.harmonic_pack(table(spark, sf_dir, "documents"), word_bpe())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe()))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = sampling.fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.join(labels.where(~held_out), "doc_id"), docs)
    scored = quality.score(docs, model).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media": op1_media,
    "op2_substrings": op2_substrings,
    "op3_language": op3_language,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_filters": op11_filters,
    "op12_divergence": op12_divergence,
    "op13_exact": op13_exact,
}

_OP5 = """
WITH r AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
     h AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM r),
     k AS (SELECT payload_digest, max(page_id) AS kept, count(*) AS n FROM h WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT h.page_id, cast(h.payload_bytes AS bigint) AS payload_bytes, h.payload_digest,
       CASE WHEN k.n > 1 AND k.kept <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.n > 1 AND k.kept <> h.page_id THEN k.kept END AS refers_to
FROM h LEFT JOIN k USING (payload_digest)
"""

_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS bigint) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     t AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

_OP8 = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
     w AS (SELECT doc_id, p, [line, lead(line) OVER d, lead(line, 2) OVER d] AS run, lead(p, 2) OVER d AS last FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
     f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS n FROM w WHERE last IS NOT NULL),
     g AS (SELECT DISTINCT doc_id, p + o AS p FROM f, (VALUES (0), (1), (2)) AS s(o) WHERE n > 1)
SELECT doc_id, cast(count(*) AS bigint) AS n_lines, cast(count(g.p) AS bigint) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY l.p), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, p) GROUP BY doc_id
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE n > 1),
     x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
     k AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
     f AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
                  + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
                  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed FROM w),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
     m AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
           FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31),
     s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, cast(step AS integer) AS step, bit,
                  cast(sum(CASE WHEN failed & bit = 0 AND failed & before = 0 THEN n ELSE 0 END) AS bigint) AS kept,
                  cast(sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN n ELSE 0 END) AS bigint) AS removed,
                  cast(sum(CASE WHEN failed & bit > 0 AND failed & before > 0 THEN n ELSE 0 END) AS bigint) AS redundant,
                  cast(sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS bigint) AS unique_fails,
                  cast(sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN good ELSE 0 END) AS bigint) AS good_lost,
                  cast(sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN toxic ELSE 0 END) AS bigint) AS toxic_lost
           FROM m, (SELECT filter_order, step, bit, cast(before AS integer) AS before FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM r
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     n AS (SELECT lang, source, term, count(*) AS c FROM x JOIN k USING (lang, term) GROUP BY lang, source, term),
     t AS (SELECT lang, source, sum(c) AS n FROM n GROUP BY lang, source),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 2)) // (coalesce(t.n, 0) + 2 * v) AS p
           FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
           LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
     q AS (SELECT lang, term, 1 + (1000000000::hugeint * (sum(c) + 2)) // (any_value(m) + 2 * any_value(v)) AS q
           FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS m FROM t GROUP BY lang) USING (lang) GROUP BY lang, term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
     e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL
           SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
     y AS (SELECT lang, source, part, item, cast(value AS bigint) AS value,
                  cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS integer) AS rank FROM e)
SELECT * FROM y WHERE part = 'pair' OR rank <= 10
"""

_OP13 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     k AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": _OP2, "op8_lines": _OP8, "op5_warc": _OP5, "op10_topk": _OP10,
    "op11_filters": _OP11, "op12_divergence": _OP12, "op13_exact": _OP13,
}
