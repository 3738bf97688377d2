"""Registered queries over the test tables: each applies one operator to whole tables.

The tables hold no tool outputs, so each operator gets the nearest table with its columns renamed or
derived.  ``oracle.py`` has the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, commitments, detect, language, redact, reduce, rules, scores, text
from ..functions.pyudf import skeleton, symbol
from ..operators import convo, impacts, intervals, matching, meter, ordered, pathkeys, search, serve, store, trigrams
from ..sources import dimensions, snapshots
from ..sources.scratch import shared_dir, size_of, stored

NOW = 1_750_000_000_000
QUERY = "please tionti stion"
PATTERN = "wh[a-z]+st"
#: A query of one word, which is searched for as a pattern, and its terms.
RECALL_PATTERN, PATTERN_TERMS = "tionti[a-z]+", ["tionti"]
#: Terms of a ranked search.
BLOCK_TERMS = ["tion", "nthe", "whst", "eaux"]
#: Terms that are looked for all at once.
FEW_TERMS = ["rati", "stion", "whst", "queux", "onth", "eaux", "ption", "please"]
#: Patterns that the index of trigrams narrows down.
PATTERNS = ["licen[cs]e", "wh[a-z]+st", "(queux|thern)t?iê?on", "ption.*thth"]
c = F.col


#: Bytes of a file that one task gets where a table is dealt out.
DEALT_BYTES = 32 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table.  Texts in fewer files than there are cores are dealt out by their id, as a file may be one row group and
    so one task, however many splits are planned for it, and what follows costs more than to move the rows."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and len(df.inputFiles()) < cores:
        return df.repartition(max(cores, -(-size_of(spark, f"{sf}/{name}.parquet") // DEALT_BYTES)), df.columns[0])
    return df


def digest_of(t: Column) -> Column:
    return F.sha2(t.cast("binary"), 256)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _stored_documents(spark, sf) -> DataFrame:
    """Documents as outputs of two workspaces (and some of none): edits among them, calls that are
    repeated, and commands on files that are proven unchanged or were modified."""
    d = table(spark, sf, "documents")
    age = F.pmod(c("doc_id"), F.lit(2000)) * 60_000
    none = F.lit(None)
    proven = F.pmod(c("doc_id"), F.lit(8)) == 2
    on_file = F.when(proven, F.lit(5.0))
    return d.select(
        "doc_id", c("text").alias("content"), c("doc_id").alias("seq"), (F.lit(NOW) - age).alias("created_at"), (F.lit(NOW) - age).alias("last_ref"), none.cast("double").alias("content_at"),
        F.when(c("doc_id") % 10 == 7, "edit_file").when(c("doc_id") % 2 == 0, "shell_command").otherwise("web_fetch").alias("source"),
        F.concat(F.when(c("doc_id") % 4 == 0, "git status ").otherwise("ls "), (c("doc_id") % 300).cast("string")).alias("command"),
        F.when(c("doc_id") % 11 == 5, none).when(c("doc_id") % 3 == 0, "other").otherwise("here").alias("workspace"), none.cast("string").alias("file_path"), none.cast("boolean").alias("edited_by_model"),
        *(on_file.alias(x) for x in ("file_mtime", "file_size", "file_ctime", "now_ctime")), F.when(proven, F.when(c("doc_id") % 16 == 2, 5.0).otherwise(6.0)).alias("now_mtime"), on_file.alias("now_size"),
        proven.alias("file_checked"), *(none.cast("double").alias(x) for x in ("dir_mtime", "dir_size", "dir_ctime")),
    )


def _recalled(out):
    return out.select(c("id").alias("doc_id"), F.round("rrf", 6).alias("rrf"), F.round("relevance", 6).alias("relevance"), "confidence", "stale", "reason", "snippet")


def recall_ranked(spark, sf):
    return _recalled(search.recall(_stored_documents(spark, sf), QUERY, 20, F.lit(NOW), "here", id_col="doc_id"))


def recall_indexed(spark, sf):
    """The same through postings: only candidates of the index are read."""
    d = _stored_documents(spark, sf)
    index = search.postings(d.where("content is not null"), "doc_id", "content")
    return _recalled(search.recall(d, QUERY, 20, F.lit(NOW), "here", id_col="doc_id", index=index))


def recall_pattern(spark, sf):
    """A single word is a pattern: candidates come from trigrams, document frequencies from postings."""
    d = _stored_documents(spark, sf)
    own = d.where("content is not null")
    index, grams = search.postings(own, "doc_id", "content"), trigrams.postings(own, "doc_id", "content")
    return _recalled(search.recall(d, RECALL_PATTERN, 20, F.lit(NOW), "here", id_col="doc_id", index=index, grams=grams))


def recall_touch(spark, sf):
    """The store after a recall: what was served was last used now."""
    d = _stored_documents(spark, sf)
    served = search.recall(d, QUERY, 20, F.lit(NOW), "here", id_col="doc_id")
    return store.touch(d, served, F.lit(NOW), "doc_id").where(c("last_ref") == NOW).select("doc_id", "last_ref")


def regex_indexed(spark, sf):
    """Patterns through one index of trigrams: only texts that have what a pattern needs are searched."""
    d = table(spark, sf, "documents")
    index = trigrams.postings(d, "doc_id", "text")
    out = None
    for pattern in PATTERNS:
        found = trigrams.search(d, index, pattern, "doc_id", "text").select(F.lit(pattern).alias("pattern"), "doc_id")
        out = found if out is None else out.unionByName(found)
    return out


def blockmax_topk(spark, sf):
    """The best 20 documents by their words, reading only blocks of postings that can hold one."""
    d = table(spark, sf, "documents")
    n = d.count()
    index = stored(impacts.block_postings(d, -(-n // impacts.BLOCK_DOCS), "doc_id", "text"), "block-postings")
    return impacts.top_k(index, BLOCK_TERMS, 20, n).select(c("id").alias("doc_id"), F.round("score", 6).alias("score"))


def index_postings(spark, sf):
    p = search.postings(table(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy(c("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def index_idf(spark, sf):
    d = table(spark, sf, "documents")
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    counted = search.postings(d, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df")).crossJoin(n)
    return counted.select("term", "df", F.round(search.idf_value(c("df"), c("n")), 6).alias("idf"))


def index_query(spark, sf):
    out = search.index_query(search.postings(table(spark, sf, "documents"), "doc_id", "text"), QUERY.split() + ["that"])
    return out.select(c("id").alias("doc_id"), "matches")


def path_lookup(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    index = p.select(F.explode(text.path_tokens("path")).alias("term"), c("page_id").alias("id"))
    return search.path_lookup(index, "25").select(c("id").alias("page_id"))


def path_lookup_many(spark, sf):
    """Every page's number looked up in the paths of all pages, as one join."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    index = p.select(F.explode(text.path_tokens("path")).alias("term"), c("page_id").alias("id"))
    terms = p.select(c("page_id").cast("string").alias("lookup"))
    return pathkeys.lookup(index, terms).groupBy("lookup").agg(F.count("*").alias("pages"), F.min("id").alias("first"))


def term_hits(spark, sf):
    """All terms at once, each text walked through one automaton."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return matching.hits(d, "t", FEW_TERMS, ["doc_id"]).groupBy("string").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"), F.sum(c("at").cast("bigint")).alias("places"))


def term_first(spark, sf):
    """The first of several terms that a text has, in the terms' order."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return matching.first_of(d, "t", FEW_TERMS).select("doc_id", "term", c("at").cast("bigint").alias("at"))


def interval_join(spark, sf):
    """Returned and accepted goods of a supplier that were out on the same days."""
    day = F.unix_date(c("l_shipdate").cast("date"))
    out = table(spark, sf, "lineitem").select(c("l_suppkey").alias("supplier"), "l_returnflag", day.alias("start"), (day + c("l_quantity").cast("int")).alias("end"))
    back, kept = (out.where(c("l_returnflag") == f).select("supplier", c("start").alias(f"{n}_start"), c("end").alias(f"{n}_end")) for f, n in (("R", "back"), ("A", "kept")))
    both = intervals.overlaps(back, kept, ["supplier"], ("back_start", "back_end"), ("kept_start", "kept_end"))
    days = F.least("back_end", "kept_end") - F.greatest("back_start", "kept_start") + 1
    return both.groupBy("supplier").agg(F.count("*").alias("pairs"), F.sum(days.cast("bigint")).alias("days"))


def breaker_states(spark, sf):
    """The breaker after every outcome of a key."""
    e = table(spark, sf, "events").select("user_id", "event_id", (c("event_type").isin("error", "click")).alias("failed"))
    return convo.breaker_states(e, "user_id", "event_id", "failed").select("user_id", "event_id", "state", "failures", "opened")


def running_estimates(spark, sf):
    """Mean and least squares of the last 200 samples at every sample."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(c("value") * 4 + 1).alias("ascii"), F.floor(c("value") + c("event_id") % 7 + 1).alias("tokens"))
    r = meter.running_estimates(e, "user_id", "event_id")
    return r.select("user_id", "event_id", "samples", "fitted", F.round("slope", 6).alias("slope"), F.round(c("intercept") + 1e-7, 4).alias("intercept"))


def snapshot_upsert(spark, sf):
    """Documents in two commits to a table of revisions, the second an upsert of what the first holds; the last revision."""
    d = table(spark, sf, "documents").select(c("text").alias("content"), (c("doc_id") * 1000).alias("ts_ms"), c("doc_id").alias("seq"))
    held = snapshots.Snapshots(spark, shared_dir(spark, "revisions"))
    old, new = (store.ingest(d.where(c("seq") % 2 == i)) for i in (0, 1))
    held.append(old)
    held.update(lambda rows: store.upsert(rows, new, keep_first=("size", "kind", "seq", "content")).select(*old.columns))
    held.expire(keep=1, grace_s=0)
    return held.read().select("hash", "size", "created_at", "last_ref", "seen", "seq")


def recall_regex_topk(spark, sf):
    d = table(spark, sf, "documents").select(c("doc_id").alias("hash"), c("text").alias("content"), F.pmod(c("doc_id") * 7919, F.lit(10007)).alias("last_ref"))
    return search.recall_regex(d, PATTERN, 10).select(c("hash").alias("doc_id"), "last_ref")


def content_store_upsert(spark, sf):
    d = table(spark, sf, "documents").select(c("text").alias("content"), (c("doc_id") * 1000).alias("ts_ms"), c("doc_id").alias("seq"))
    # two batches of outputs, the second upserted into the store of the first
    old, new = (store.ingest(d.where(c("seq") % 2 == i)) for i in (0, 1))
    both = store.upsert(old, new, keep_first=("size", "kind", "seq", "content"))
    return both.select("hash", "size", "created_at", "last_ref", "seen", "seq")


def supersede_antijoin(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", c("source").alias("file_path"), (c("doc_id") - c("doc_id") % 40).cast("double").alias("file_mtime"), (c("n_chars") % 5).cast("string").alias("hash"))
    return store.supersede(d).select("doc_id", "superseded")


def invalidate_theta(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("file_path"))
    blobs = p.withColumn("source", F.when(c("page_id") % 3 == 0, "read_file").otherwise("grep"))
    edits = p.where("page_id % 25 = 0").select(F.regexp_replace("file_path", "/[^/]*$", "").alias("path"))
    return store.invalidate(blobs, edits).select("page_id", "edited")


def as_of_prior_version(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    day = F.date_trunc("day", c("ts").cast("timestamp"))
    out = ordered.last_before(e, ["user_id"], ["ts", "event_id"], F.when(c("event_type") == "purchase", c("event_id")), day, "prior_purchase")
    return out.where("event_type = 'error'").select("event_id", "prior_purchase")


def prior_versions(spark, sf):
    e = table(spark, sf, "events").select("event_id", c("user_id").alias("file_path"), millis(c("ts")).alias("last_ref"), c("event_id").alias("seq"))
    return store.prior_versions(e, 5).select("event_id", c("place").cast("bigint").alias("place"))


def best_version(spark, sf):
    e = table(spark, sf, "events").select("event_id", c("user_id").alias("file_path"), (c("event_type") == "view").alias("full_file"), millis(c("ts")).alias("last_ref"), millis(c("ts")).alias("created_at"), c("event_id").alias("seq"))
    return store.best_version(e).select(c("file_path").alias("user_id"), "event_id")


def evict_over_cap(spark, sf):
    e = table(spark, sf, "events").select(c("event_id").alias("hash"), F.round(c("value") * 100).cast("bigint").alias("size"), millis(c("ts")).alias("last_ref"), millis(c("ts")).alias("created_at"))
    return store.evict(e, F.lit(NOW), 5_000_000, 2000).select(c("hash").alias("event_id"))


def newest_per_command(spark, sf):
    e = table(spark, sf, "events").select(c("event_id"), c("user_id").cast("string").alias("source"), c("event_type").alias("command"), F.round("value").cast("string").alias("hash"), millis(c("ts")).alias("last_ref"), c("event_id").alias("seq"))
    return store.newest_per_command(e).select("event_id", "supplanted")


def _freshness_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k, none = c("event_id") % 11, F.lit(None)
    kinds = {"click": "read_file", "view": "shell_command", "purchase": "web_search", "error": "read_file"}
    source = F.lit("shell_command")
    for a, b in kinds.items():
        source = F.when(c("event_type") == a, b).otherwise(source)
    return e.select(
        "event_id", source.alias("source"), F.when(k % 2 == 0, "git diff").otherwise("make").alias("command"),
        F.when(k == 0, none.cast("string")).when(k == 1, "other").otherwise("here").alias("workspace"), F.when(k != 2, "f").alias("file_path"),
        F.when(k != 3, c("value")).alias("file_mtime"), F.when(k != 3, k).cast("double").alias("file_size"), F.when(k != 4, F.lit(1.0)).alias("file_ctime"),
        F.when(k != 5, F.when(k == 6, c("value") + 1).otherwise(c("value"))).alias("now_mtime"), k.cast("double").alias("now_size"), F.when(k == 7, F.lit(2.0)).when(k != 8, F.lit(1.0)).alias("now_ctime"),
        (c("event_id") % 5 < 3).alias("file_checked"), F.lit(False).alias("dir_checked"), *(none.cast("double").alias(x) for x in ("dir_mtime", "dir_size", "dir_ctime", "dir_now_mtime", "dir_now_size", "dir_now_ctime")),
        (c("event_id") % 13 == 0).alias("edited_by_model"), none.cast("double").alias("content_at"), millis(c("ts")).alias("created_at"), millis(c("ts")).alias("last_ref"), (c("event_id") % 17 == 0).alias("superseded"),
    )


FRESH_NOW = 1_704_240_000_000


def freshness_score(spark, sf):
    rows = _freshness_rows(spark, sf).withColumn("c", scores.confidence("here", F.lit(FRESH_NOW), "superseded"))
    return rows.select("event_id", c("c.score").alias("score"), c("c.stale").alias("stale"))


def freshness_flags(spark, sf):
    rows = _freshness_rows(spark, sf).withColumn("c", scores.confidence("here", F.lit(FRESH_NOW), "superseded"))
    return rows.select("event_id", F.array_join("c.flags", "; ").alias("flags"), F.when(c("c.stale"), scores.stale_reason("c.flags")).alias("reason"))


def content_type_detect(spark, sf):
    d = table(spark, sf, "documents").select(c("doc_id").alias("id"), F.lit("document").alias("origin"), "text")
    p = table(spark, sf, "pages").select(c("page_id").alias("id"), F.lit("page").alias("origin"), c("html").alias("text"))
    e = table(spark, sf, "events").select(c("event_id").alias("id"), F.lit("event").alias("origin"), c("props").alias("text"))
    every = d.unionByName(p).unionByName(e).withColumn("d", detect.detect_type("text")).withColumn("v", detect.line_votes("text"))
    return every.select("origin", "id", c("d.type").alias("type"), F.round("d.confidence", 6).alias("confidence"), detect.route("d.type").alias("route"), "v.log", "v.search", "v.code", "v.n")


def binary_detect(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 7 == 0, F.base64(c("text").cast("binary"))).otherwise(c("text")).alias("t"))
    wrapped = F.when(c("doc_id") % 7 == 0, F.regexp_replace(F.regexp_replace("t", "[\r\n]", ""), "(.{76})", "$1\n")).otherwise(c("t"))
    return d.select("doc_id", detect.is_binary(wrapped).alias("is_binary"))


def language_detect(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", language.detect_language("text").alias("language"), language.stopword_counts("text").alias("s")).select("doc_id", "language", "s.fr", "s.en", "s.es", "s.de")


def commitments_kept(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", commitments.compare("text", F.left("text", F.lit(500))).alias("r"))
    return d.select("doc_id", c("r.total").alias("total"), c("r.preserved").alias("preserved"), *(c(f"r.by_kind.{k}").alias(k) for k in commitments.KINDS))


def commitments_crushed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", commitments.compare("text", reduce.crush_text("text")["text"]).alias("r"))
    return d.select("doc_id", c("r.total").alias("total"), c("r.preserved").alias("preserved"), *(c(f"r.by_kind.{k}").alias(k) for k in commitments.KINDS))


def redact_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", redact.redact("text").alias("r"))
    return d.select("doc_id", *(c(f"r.counts.{k.replace('-', '_')}").alias(k.replace("-", "_")) for k in redact.PATTERNS))


def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact.redact("text").alias("r")).select("doc_id", "r.text", c("r.counts.entropy").alias("entropy"))


def char_entropy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(text.char_entropy("text"), 6).alias("bits"))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"), text.count_lines("text").cast("bigint").alias("lines"), text.blob_ref(text.content_hash("text"), "text").alias("ref"))


def bigram_shingles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.bigrams("text")).cast("bigint").alias("n"))


def dedup_runs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[.] ", ".\n").alias("t"))
    doubled = d.select("doc_id", F.regexp_replace("t", "(?m)^([^\n]{1,30})$", "$1\n$1").alias("t"))
    return doubled.select("doc_id", digest_of(text.dedup_runs("t")).alias("sha"), F.length(text.dedup_runs("t")).cast("bigint").alias("chars"))


def _logs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.concat_ws(" ", F.date_format(c("ts").cast("timestamp"), "HH:mm:ss"), F.when(c("event_type") == "error", "error").otherwise("info"), F.concat(F.lit("user "), c("user_id") % 3), F.concat(c("event_type"), F.lit(" took "), F.floor("value"), F.lit(" ms")))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l")).select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))


def log_template_collapse(spark, sf):
    r = _logs(spark, sf).select("user_id", reduce.collapse_log("t").alias("r"))
    return r.select("user_id", digest_of(c("r.text")).alias("sha"), c("r.templates").alias("templates"), c("r.was_collapsed").alias("collapsed"))


def group_squash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", r"(?<=\.) |\n"), lambda x, i: F.concat(F.lit("dir/f"), i % 29, F.lit(".ts:"), i, F.lit(":"), x)), "\n").alias("t"))
    r = d.select("doc_id", rules.group_squash(c("t"), 1500).alias("r")).where("r is not null")
    return r.select("doc_id", c("r.matches").alias("matches"), c("r.shown_files").alias("shown_files"), c("r.all_files").alias("all_files"), digest_of(c("r.text")).alias("sha"))


def salient_crush(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", reduce.crush_text("text").alias("r"))
    return r.select("doc_id", c("r.was_crushed").alias("crushed"), c("r.segments_before").alias("segments_before"), c("r.segments_after").alias("segments_after"), digest_of(c("r.text")).alias("sha"))


def prose_compress(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", reduce.compress_prose("text").alias("r"))
    return r.select("doc_id", "r.was_compressed", "r.lang", "r.words", "r.dropped", "r.restored", digest_of(c("r.text")).alias("sha"))


def _json_arrays(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("cents", F.round(c("value") * 100).cast("bigint"))
    row = F.struct("event_id", "event_type", "cents", "user_id")
    return e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("t"))


def table_compact(spark, sf):
    r = _json_arrays(spark, sf).select("user_id", reduce.compact_table("t").alias("r"))
    return r.select("user_id", "r.was_compacted", "r.rows", "r.cols", digest_of(c("r.text")).alias("sha"))


def json_crush(spark, sf):
    return _json_arrays(spark, sf).select("user_id", reduce.crush_json("t").alias("r")).select("user_id", "r.was_crushed", "r.rows_before", "r.rows_after", "r.text")


def anchors(spark, sf):
    """Anchors of whole pages with their addresses."""
    return table(spark, sf, "pages").select("page_id", F.array_join(reduce.anchors(F.concat_ws(" ", "url", "html")), "|").alias("anchors"))


def smart_compress(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", reduce.smart_compress("text").alias("r"), "text")
    return r.groupBy("r.strategy").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("before"), F.sum(F.length("r.text")).alias("after"))


TRACE = "start\nError: boom\n    at run (src/app.js:1:2)\n    at load (node_modules/x/y.js:3:4)\n    at Module.go (internal.js:5:6)\nend"


def stack_traces(spark, sf):
    """Whole texts as they are, with two traces behind them."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), F.lit(TRACE), F.lit(TRACE)).alias("t"))
    r = d.select("doc_id", reduce.compress_traces("t").alias("r"), "t")
    return r.select("doc_id", c("r.traces").alias("traces"), (F.length("t") - F.length("r.text")).cast("bigint").alias("saved"), digest_of(c("r.text")).alias("sha"))


def digest_rules(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.array(*map(F.lit, ("shell_command", "grep", "read_file"))), (c("doc_id") % 3 + 1).cast("int")).alias("tool"),
        F.element_at(F.array(*map(F.lit, ("ls -l", "cat x.txt", "npm test", "cd a && echo hi"))), (c("doc_id") % 4 + 1).cast("int")).alias("command"), "text",
    )
    r = d.select("doc_id", rules.digest("tool", "command", "text", c("doc_id") % 19 == 0).alias("r"))
    return r.select("doc_id", c("r.rule").alias("rule"), c("r.saved_chars").alias("saved_chars"))


def digest_arms(spark, sf):
    """Rules for particular commands, over documents whose words are written as such outputs: the whole digested text."""
    words = F.array_remove(F.split("text", r"\s+"), "")
    arm = c("doc_id") % 5
    number = lambda at: (at + 1).cast("string")
    own = lambda x, at: F.concat(x, number(at))
    # the arm is asked once a text, not at each of its words
    forms = [
        lambda x, at: F.concat(F.lit(" M "), x, number(at)),
        lambda x, at: F.when((at + 1) % 5 == 0, F.concat(F.lit("added "), number(at), F.lit(" packages"))).when((at + 1) % 7 == 0, F.concat(own(x, at), F.lit(" severity high"))).otherwise(own(x, at)),
        lambda x, at: F.concat(number(at), F.when((at + 1) % 2 == 0, ":1 info ").otherwise(":1 error "), x),
        lambda x, at: F.when((at + 1) % 3 == 0, F.concat(F.lit("["), number(at), F.lit("/9] "), x)).otherwise(own(x, at)),
        lambda x, at: F.concat(F.when((at + 1) % 60 == 1, "+").otherwise(" "), x, number(at)),
    ]
    written = [F.array_join(F.transform(words, f), "\n") for f in forms]
    out = F.when(arm == 0, F.concat(F.lit("On branch main\n"), written[0]))
    for i in (1, 2, 3):
        out = out.when(arm == i, written[i])
    out = out.otherwise(written[4])
    tool = F.when(arm == 2, "get_diagnostics").otherwise("shell_command")
    command = F.when(arm == 0, "git status").when(arm == 1, "npm install").when(arm == 3, "make all").when(arm == 4, "git diff HEAD")
    d = table(spark, sf, "documents").select("doc_id", out.alias("t"), tool.alias("tool"), command.alias("command"))
    r = d.select("doc_id", rules.digest("tool", "command", "t").alias("r"))
    return r.select("doc_id", c("r.rule").alias("rule"), digest_of(c("r.text")).alias("sha"), c("r.saved_chars").alias("saved_chars"))


def head_squash(spark, sf):
    out = rules.squash(c("text"), 2000, "[{n} chars, {lines} lines]\n{head}")
    return table(spark, sf, "documents").select("doc_id", digest_of(out).alias("sha"), F.length(out).cast("bigint").alias("chars"))


def keep_last_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", digest_of(text.keep_last("text", 3)).alias("sha"))


def line_window(spark, sf):
    w = text.line_window("text", (c("doc_id") % 4).cast("int"), F.lit(3))
    return table(spark, sf, "documents").select("doc_id", digest_of(w).alias("sha"))


def line_numbers_strip(spark, sf):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == c("doc_id") % 3, x).otherwise(F.concat(i + 1, F.lit(": "), x))), "\n")
    return table(spark, sf, "documents").select("doc_id", digest_of(text.strip_line_numbers(numbered)).alias("sha"))


def _messages(spark, sf) -> DataFrame:
    m = table(spark, sf, "conversations")
    return m.select("conv_id", "turn", "role", c("text").alias("content"), F.lit(False).alias("is_error"), (c("turn") % 5 == 4).alias("is_summary"))


def mask_observations(spark, sf):
    m = convo.mask(_messages(spark, sf), ("assistant",), 1, 1, 300, 0.05)
    return m.select("conv_id", "turn", "verdict", "masked", F.length("content").cast("bigint").alias("chars"))


def context_tokens(spark, sf):
    return convo.context_tokens(_messages(spark, sf))


def epoch_detect(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return convo.epochs(m, least_drop=200).select("conv_id", "turn", "epoch")


def frozen_prefix(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.left("text", (c("turn") % 3 * 40 + 20).cast("int")).alias("p"))
    same = m.select("conv_id", "turn", F.when(c("conv_id") % 2 == 0, F.left(F.lit("the same beginning of every turn's prefix, whatever follows"), (c("turn") * 9 + 10).cast("int"))).otherwise(c("p")).alias("prefix"))
    return convo.frozen_prefix(same).select("conv_id", "turn", F.round("lcp_ratio", 6).alias("ratio"), "cause")


def frozen_turns(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", c("text").alias("prefix"))
    return convo.frozen_prefix(m).select("conv_id", "turn", F.round("lcp_ratio", 6).alias("ratio"), "cause")


def view_toc(spark, sf):
    d = table(spark, sf, "documents").select(text.content_hash("text").alias("hash"), c("doc_id").alias("seq"), F.lit("text").alias("kind"), c("text").alias("content"))
    return convo.toc(d).select("seq", "line", "ref")


def breaker_fold(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (c("event_type").isin("error", "click")).alias("failed"))
    return convo.breaker(e, "user_id", "event_id", "failed")


def diff_summary(spark, sf):
    from pyspark.sql import Window

    m = table(spark, sf, "conversations").where("text is not null")
    pairs = m.withColumn("old", F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("old is not null")
    return serve.delta_decisions(pairs.select("conv_id", "turn", "old", c("text").alias("new"))).select("conv_id", "turn", "added", "removed", "changed_ratio", "decision", "reason")


def _usages(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    tokens = F.round(c("value") * 100).cast("bigint")
    return e.select(c("user_id").cast("string").alias("session"), c("event_id").alias("turn"), F.concat(F.lit("Vendor/model-"), c("user_id") % 5).alias("model"), tokens.alias("input_tokens"), F.round(c("value") * 10).cast("bigint").alias("output_tokens"), F.floor(tokens * (c("event_id") % 4) / 4).cast("bigint").alias("cache_read"))


def _prices(spark) -> DataFrame:
    return spark.sql("select * from values ('vendor/model-0', 3.0D, 15.0D, 0.3D), ('other/model-1', 1.0D, 2.0D, null), ('model-2-large', 5.0D, 25.0D, null), ('tiny', 0.1D, 0.2D, 0.01D) as t(id, input_per_m, output_per_m, cache_read_per_m)")


def usage_stats(spark, sf):
    s = meter.usage_stats(_usages(spark, sf), "session")
    return s.withColumn("cache_ratio", F.round("cache_ratio", 6))


def usage_cost(spark, sf):
    k = meter.cost(_usages(spark, sf), _prices(spark))
    return k.groupBy("model", "price_id").agg(F.round(F.sum("cost"), 6).alias("cost"))


def ols_tokens(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("lang", F.length("text").alias("ascii"), F.regexp_count("text", F.lit("[éèàüöäß]")).alias("cjk"), (F.floor(F.length("text") / 4) + F.length("source")).alias("tokens"))
    o = meter.ols(d, "lang")
    return o.select("lang", "samples", F.round("slope_ascii", 4).alias("slope_ascii"), (F.round("slope_cjk", 3) + 0.0).alias("slope_cjk"), F.round("intercept", 2).alias("intercept"))


def running_mean(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (c("value") * 4 + 1).alias("chars"), (c("value") + 1).alias("tokens"))
    r = meter.running_ratio(e, "user_id", "event_id", memory=8)
    return r.select("user_id", "samples", F.round("chars_per_token", 6).alias("chars_per_token"))


def ece_bins(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.pmod(c("n_chars") * 37, F.lit(101)) / 100.0).alias("confidence"), (c("quality") == 1).alias("hit"))
    return meter.calibration_bins(rows).select(c("bin").cast("bigint").alias("bin"), "n", *(F.round(x, 6).alias(x) for x in ("confidence", "accuracy", "gap")))


def pressure_growth(spark, sf):
    g = meter.growth(_usages(spark, sf))
    p = g.withColumn("p", scores.pressure(c("growth"), c("cache_ratio"), c("turn") % 80))
    return p.select("session", "turn", F.round("growth", 6).alias("growth"), F.round("cache_ratio", 6).alias("cache_ratio"), c("p.score").alias("score"), c("p.level").alias("level"))


def cache_dips(spark, sf):
    return meter.cache_dips(_usages(spark, sf)).select("session", "turn", "dip")


def budget_info(spark, sf):
    u = _usages(spark, sf).withColumn("b", scores.budget("input_tokens", F.lit(10_000)))
    return u.select("session", "turn", c("b.headroom").alias("headroom"), F.round("b.headroom_pct", 6).alias("pct"), c("b.over_budget").alias("over"), c("b.warn").alias("warn"))


KINDS = ["click", "error", "purchase", "view"]


def session_snapshot(spark, sf):
    return meter.session_snapshot(table(spark, sf, "events"), "user_id", "event_type", "ts", KINDS)


def active_ttl(spark, sf):
    e = table(spark, sf, "events")
    return meter.active_within(e, ["user_id", "event_type"], "ts", 6 * 3600).select("event_id", "still")


def heartbeat_live(spark, sf):
    e = table(spark, sf, "events")
    return meter.live_sessions(e, F.lit("2024-01-08 00:00:00").cast("timestamp"), "user_id", "ts", 6 * 3600).select("user_id", "alive")


def recall_followed(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").alias("session"), c("event_id").alias("seq"), c("event_type").alias("tool"))
    return meter.followed_by(e, "view", ("purchase", "click")).select("seq", "followed")


def playbook_top(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").alias("path"), (c("event_type") != "error").alias("helped"), millis(c("ts")).alias("at"))
    return meter.playbook(e)


def ring_buffer(spark, sf):
    return meter.last_n(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 7)


def _files(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").withColumn("p", F.concat("source", F.lit("/"), (c("doc_id") % 50).cast("string"), F.lit(".txt")))
    v = c("doc_id").cast("double")
    blobs = d.select(
        text.content_hash("text").alias("hash"), c("p").alias("file_path"), F.lit("read_file").alias("source"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("search_pattern"),
        v.alias("file_mtime"), c("n_chars").alias("file_size"), v.alias("file_ctime"), (c("doc_id") % 2 == 0).alias("full_file"), c("doc_id").alias("last_ref"), c("doc_id").alias("created_at"), c("doc_id").alias("seq"), c("n_chars").alias("size"), c("text").alias("content"),
    )
    newest = d.groupBy("p").agg(F.max_by(F.struct("doc_id", "n_chars"), "doc_id").alias("r")).where("r.doc_id % 9 <> 0")
    snapshot = newest.select(c("p").alias("path"), c("r.doc_id").cast("double").alias("mtime"), (c("r.n_chars") + F.when(c("r.doc_id") % 4 == 0, 1).otherwise(0)).alias("size"), c("r.doc_id").cast("double").alias("ctime"))
    return blobs, snapshot


def freshness_replay(spark, sf):
    return serve.replay(*_files(spark, sf))


def tool_hits(spark, sf):
    blobs, snapshot = _files(spark, sf)
    calls = blobs.select(c("seq").alias("call_id"), c("source").alias("tool"), "command", c("file_path").alias("path"), F.lit(None).cast("string").alias("pattern"))
    return serve.tool_hits(calls, blobs, snapshot).groupBy("decision", "reason").agg(F.count("*").alias("calls"))


def window_serve(spark, sf):
    blobs, snapshot = _files(spark, sf)
    asked = blobs.select(c("seq").alias("call_id"), c("file_path").alias("path"), F.lit(2).alias("offset"), F.lit(2).alias("limit"))
    return serve.windows(asked, blobs, snapshot).select("call_id", "reason", digest_of(c("window")).alias("sha"))


def freshness_audit(spark, sf):
    blobs, _ = _files(spark, sf)
    actual = store.best_version(blobs).where("seq % 7 <> 0").select(c("file_path").alias("path"), F.when(c("seq") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(c("content")).alias("content"))
    return serve.audit(blobs.select(c("seq").alias("id"), c("file_path").alias("path"), "content"), actual).groupBy("verdict").agg(F.count("*").alias("rows"))


COMMANDS = [
    ("cd x && git status", False), ("git push origin", True), ("sudo rm -rf /tmp/x", True), ("timeout 5 ls", False), ("FOO=1 make deploy", True), ("cat a | grep b", False),
    ("curl -o f http://x", True), ("curl http://x", False), ("echo $(rm x)", True), ("tail -f log", True), ("", False), ("npm test", True), ("ls; mkdir y", True),
]


def side_effects(spark, sf):
    """A command for every document, with the document's first word behind it."""
    kind = F.element_at(F.array(*(F.lit(x) for x, _ in COMMANDS)), (c("doc_id") % len(COMMANDS) + 1).cast("int"))
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    return table(spark, sf, "documents").select("doc_id", commands.is_side_effect(F.concat(kind, F.lit(" x"), word)).alias("effect"))


def price_html_extract(spark, sf):
    p = table(spark, sf, "pages").withColumn("html", F.concat("html", F.format_string("<table><tr><th>Model</th><th>In</th><th>Out</th></tr><tr><td>M-%d</td><td><s>$9</s> $%d.5</td><td>$7</td></tr><tr><td></td><td>$2</td><td>%d</td></tr></table>", c("page_id"), c("page_id") % 10, c("page_id"))))
    return dimensions.prices_html(p, "page_id", "html").select(c("id").alias("page_id"), c("row").cast("bigint").alias("row"), "model", "input_per_m", "output_per_m")


def symbol_extract(spark, sf):
    """The first script of every page: where its variable ``t`` is defined, and its skeleton."""
    code = F.regexp_replace(F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1), ";", ";\n")
    code = F.when(F.length(code) > 0, F.concat(F.lit("function page("), c("page_id"), F.lit(") {\n"), code, F.lit("}\nconst z = 1;")))
    p = table(spark, sf, "pages").select("page_id", code.alias("code")).where("code is not null")
    return p.select("page_id", symbol("page")(c("code")).alias("definition"), skeleton(c("code")).alias("skeleton"))


def stream_session_counts(spark, sf):
    """The session fold over a file stream, read to its end."""
    from ..streaming import stateful

    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = stateful.session_counts(rows.withColumn("ts", millis(c("ts"))), KINDS, "user_id", "event_type", "ts")
    out = shared_dir(spark, "stream-counts")
    writer = counted.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("complete")
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = max(stateful._numbers(spark, out, "batch"))
    return spark.read.parquet(f"{out}/batch={last}").select("user_id", "events", *(f"n_{k}" for k in KINDS), "started", "last_at")


def rollup_bench(spark, sf):
    r = table(spark, sf, "documents").where("text is not null").select("lang", F.length("text").cast("bigint").alias("before"), F.length(reduce.crush_text("text")["text"]).cast("bigint").alias("after"))
    return meter.reduction_report(r, "lang", "before", "after").select("lang", "items", "before", "after")


QUERIES = {
    f.__name__: f
    for f in (
        recall_ranked, recall_indexed, recall_pattern, recall_touch, regex_indexed, blockmax_topk, path_lookup_many, term_hits, term_first, interval_join, breaker_states, running_estimates, snapshot_upsert, index_postings, index_idf, index_query, path_lookup, recall_regex_topk, content_store_upsert, supersede_antijoin, invalidate_theta, as_of_prior_version,
        prior_versions, best_version, evict_over_cap, newest_per_command, freshness_score, freshness_flags, content_type_detect, binary_detect, language_detect, commitments_kept, commitments_crushed, redact_counts,
        redact_text, char_entropy, token_estimate, bigram_shingles, dedup_runs, log_template_collapse, group_squash, salient_crush, prose_compress, table_compact, json_crush, anchors,
        smart_compress, stack_traces, digest_rules, digest_arms, head_squash, keep_last_n, line_window, line_numbers_strip, mask_observations, context_tokens, epoch_detect, frozen_prefix, frozen_turns, view_toc,
        breaker_fold, diff_summary, usage_stats, usage_cost, ols_tokens, running_mean, ece_bins, pressure_growth, cache_dips, budget_info, session_snapshot, active_ttl, heartbeat_live,
        recall_followed, playbook_top, ring_buffer, freshness_replay, tool_hits, window_serve, freshness_audit, side_effects, price_html_extract, symbol_extract, stream_session_counts, rollup_bench,
    )
}
