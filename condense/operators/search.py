"""Inverted index, relevance, fusion and recall."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.language import STOPWORDS
from ..sources.scratch import drop_stored, stored
from . import trigrams

RRF = 60
IDF_LEAST_DOCS = 20
QUERY_CHARS = 512
FULL_CHARS = 24 * 1024
#: Calls whose outputs repeat what the model has written.
OWN_WRITES = ("edit_file", "write_file", "apply_patch", "create_file")


def query_terms(query: str, stopwords: list[str] | None = None) -> list[str]:
    """Folded words of a query without stopwords, each once."""
    import unicodedata

    stop = set(stopwords if stopwords is not None else " ".join(STOPWORDS.values()).split())
    folded = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [t for t in dict.fromkeys(re.findall(r"[a-z][a-z0-9]{2,}", folded)) if t not in stop]


def postings(docs: DataFrame, id_col: str = "hash", text_col: str = "content", path_col: str | None = None) -> DataFrame:
    """``term, id, tf``: distinct tokens of each document; a token of the path counts once more.

    Tokens are made distinct within the row, so without paths nothing is shuffled."""
    words = docs.select(F.explode(text.identifier_tokens(text_col)).alias("term"), F.col(id_col).alias("id"))
    if path_col is None:
        return words.withColumn("tf", F.lit(1).cast("bigint"))
    paths = docs.where(F.col(path_col).isNotNull()).select(F.explode(F.array_distinct(text.path_tokens(path_col))).alias("term"), F.col(id_col).alias("id"))
    return words.unionByName(paths).groupBy("term", "id").agg(F.count("*").alias("tf"))


def idf_value(df: Column, n_docs: Column) -> Column:
    """``ln(1 + (n - df + 0.5) / (df + 0.5))``."""
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def idf(index: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf``; postings hold a document once a term."""
    return index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf_value(F.col("df"), F.lit(n_docs)))


def index_query(index: DataFrame, terms: list[str]) -> DataFrame:
    """``id, matches``: how many of the terms' tokens a document has."""
    tokens = sorted({p for t in terms for a in t.lower().split() for p in [a, *(x for x in re.split(r"[_./\\-]+", a) if len(x) >= 3)]})
    return index.where(F.col("term").isin(*tokens)).groupBy("id").agg(F.count("*").alias("matches"))


def path_lookup(index: DataFrame, path_term: str) -> DataFrame:
    """Ids whose path token is the term; failing that, ends with it or has it in its last segment."""
    t = path_term.strip().lower()
    term = F.col("term")
    last = F.element_at(F.split(term, "/"), -1)
    loose = (F.length(term) > len(t)) & (term.endswith(t) | last.contains(t))
    hits = index.where((term == t) | loose).groupBy("id").agg(F.max(term == t).alias("exact"))
    any_exact = F.broadcast(index.where(term == t).agg((F.count("*") > 0).alias("found")))
    return hits.crossJoin(any_exact).where(F.col("exact") | ~F.col("found")).select("id")


def remove_ids(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings without the documents in ``removed`` (``id``)."""
    return index.join(removed.select("id").distinct(), "id", "left_anti")


def pattern_of(query: str) -> str:
    """A query as a pattern: itself, or, where the engine cannot read it as one, its text."""
    from pyspark.sql import SparkSession

    query, session = query[:QUERY_CHARS], SparkSession.getActiveSession()
    try:
        if session is not None:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(query)
        else:
            re.compile(query)
    except (re.error, IllegalArgumentException):
        return re.escape(query)
    return query


def matches(content: Column, query: str) -> Column:
    """Search for a pattern in any case; a query that is no pattern is searched for as text."""
    return content.rlike(trigrams.IN_ANY_CASE + pattern_of(query))


def found_at(content: Column, query: str) -> Column:
    """1-based place where a query is found in a text, 0 where it is not: of several words, the first one (in
    their order) that the text has; a single word is a pattern, or text if it is none."""
    words = text_words(query)
    if len(words) > 1:
        return first_place(F.lower(content), words)
    return F.regexp_instr(content, F.lit(trigrams.IN_ANY_CASE + pattern_of(query)))


def recall_regex(blobs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The most recently used of the outputs that match."""
    return blobs.where(matches(F.col("content"), query)).orderBy(F.desc("last_ref"), "hash").limit(limit)


def snippet(content: Column, at: Column, budget: Column) -> Column:
    """``budget`` characters around a 1-based place, or the whole content where it is no longer; near its
    end, its last ``budget`` characters."""
    start = F.least(F.greatest(F.lit(1), at - F.floor(budget / 2)), F.length(content) - budget + 1)
    return F.when(F.length(content) <= budget, content).otherwise(F.substr(content, start.cast("int"), budget.cast("int")))


def rrf(*ranks: Column, k: int = RRF) -> Column:
    """Reciprocal rank fusion; ranks below 1 count nothing."""
    parts = [F.when(r > 0, 1.0 / (F.lit(k) + r)).otherwise(0.0) for r in ranks]
    return sum(parts[1:], parts[0])


def fused_top(rows: DataFrame, by: list[tuple[str, bool]], limit: int, k: int = RRF) -> DataFrame:
    """The best ``limit`` rows by the reciprocal ranks of several orders, with ``rrf`` and ``r_<column>``.

    ``by``: columns and whether they fall; equal values go by ``id``.  Only rows among the first ``n (k + limit)`` or so
    of an order can be among the best, so those, of each order, come to the driver.  Their places in
    the other orders come from one pass that counts the rows between them; it sends one row a candidate and order.
    Nothing here grows with ``rows`` but the counts.  Work happens when this is called.
    """
    n, spark = len(by), rows.sparkSession
    reach = n * (k + limit) - k + 1
    first = [rows.orderBy(F.col(c).desc() if falls else F.col(c).asc(), "id").limit(reach).collect() for c, falls in by]
    some = {r.id: r for own in first for r in own}
    ranks = [{r.id: i for i, r in enumerate(own, 1)} for own in first]
    for (c, falls), own, rank in zip(by, first, ranks, strict=True):
        others = [r for i, r in some.items() if i not in rank]
        if not others:
            continue
        others.sort(key=lambda r: (-r[c] if falls else r[c], r.id))
        kinds = f"k array<struct<v: {rows.schema[c].dataType.simpleString()}, id: {rows.schema['id'].dataType.simpleString()}>>"
        keys = spark.createDataFrame([([(-r[c] if falls else r[c], r.id) for r in others],)], kinds)
        key = F.struct((-F.col(c) if falls else F.col(c)).alias("v"), F.col("id").alias("id"))
        place = F.size(F.filter("k", lambda x: x < key))  # noqa: B023
        counts = dict(rows.crossJoin(F.broadcast(keys)).groupBy(place.alias("at")).count().collect())  # keys are one row
        before = 0
        for at, r in enumerate(others):
            before += counts.get(at, 0)
            rank[r.id] = before
    out = []
    for i, r in some.items():
        score = Decimal(repr(sum(1.0 / (k + rank[i]) for rank in ranks))).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        out.append((*r, *(rank[i] for rank in ranks), float(score)))
    at = rows.columns.index("id")
    out.sort(key=lambda x: (-x[-1], x[at]))
    added = ", ".join([*(f"`r_{c}` bigint" for c, _ in by), "rrf double"])
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spark.createDataFrame(out[:limit], f"{held}, {added}")


def first_place(text_: Column, terms: list[str]) -> Column:
    """Place of the first term (in their order) that the text has, 0 for none."""
    return F.coalesce(*(F.nullif(F.locate(t, text_), F.lit(0)) for t in terms), F.lit(0))


def is_token(folded: Column, term: str) -> Column:
    """Whether :func:`condense.functions.text.identifier_tokens` of a folded text have a word of letters and
    digits, without making them."""
    edge = r"[^\s_./\\-]"
    return folded.contains(term) & folded.rlike(rf"(?<!{edge}){term}(?!{edge})")


def in_scope(workspace: str | None) -> Column:
    """Rows that a workspace may recall: its own, or those of none where none is given; never what the
    model itself has written."""
    own = F.coalesce("workspace", F.lit("")) == F.lit(workspace or "")
    return own & ~F.coalesce("source", F.lit("")).isin(*OWN_WRITES)


def candidates(docs: DataFrame, index: DataFrame | None, query: str, id_col: str = "hash", grams: DataFrame | None = None) -> DataFrame:
    """Documents that the index knows to hold one of the query's words, or, if it knows of none, all.  A
    single word goes through the index only if it looks like a path, and else through ``grams``
    (:func:`trigrams.postings`): only documents with the trigrams that its pattern needs are left."""
    words = text_words(query)
    if len(words) > 1 and index is not None:
        ids = index_query(index, words).select("id")
    elif len(words) == 1 and index is not None and re.search(r"[\\/.]", query):
        ids = path_lookup(index, query)
    elif len(words) == 1 and grams is not None:
        ids = trigrams.candidates(grams, pattern_of(query))
        return docs if ids is None else docs.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi").select(*docs.columns)
    else:
        return docs
    found = ids.select(F.col("id").alias(id_col), F.lit(True).alias("__found"))
    some = F.broadcast(ids.agg((F.count("*") > 0).alias("__some")))  # one row
    kept = docs.join(found, id_col, "left").crossJoin(some).where(F.col("__found") | ~F.col("__some"))
    return kept.select(*docs.columns)


def text_words(query: str) -> list[str]:
    return [w for w in query[:QUERY_CHARS].lower().split() if w]


def recall(docs: DataFrame, query: str, limit: int = 10, now: Column | None = None, workspace: str | None = None, budget: int = 2000,
           id_col: str = "hash", mode: str = "relevance", index: DataFrame | None = None, full_content: bool = False,
           grams: DataFrame | None = None) -> DataFrame:
    """Ranked recall over stored outputs (the columns of the store with ``content``).

    Of the workspace's rows that no edit or write of the model has made, those with one of the query's
    words are found, or, for a single word, those that it matches as a pattern (as text where it is
    none); a blank query finds nothing.  They are scored by freshness, where a row of which the same call has a
    later output is superseded, and by relevance to the query's folded words without stopwords (0 where
    it has none).  The ranks of the fresh rows are fused, and the best ``limit`` come
    with a snippet, or (``full_content``) whole if the row holds a full file of at most ``FULL_CHARS``.
    Up to ``limit`` stale rows follow without content, but with a reason.  ``mode="scan_order"``
    fuses the order of storage instead of relevance.  :func:`store.touch` notes what was served.

    With ``index`` (:func:`postings` of the store) or, for single words, ``grams`` (:func:`trigrams.postings`) only their
    candidates are read.  Document frequencies are those of the workspace's own rows; with ``grams`` alone there are
    none, and terms weigh by their length.  Ranking happens when this is
    called: texts are read once for scores, of which a slim table is written and dropped again,
    and, for the at most twice ``limit`` rows that come, by their ids when the result is read.
    """
    now = now if now is not None else F.unix_millis(F.current_timestamp())
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, rrf double, relevance double, confidence bigint, stale boolean, reason string, at int, room bigint, whole boolean"
    if not query.strip():
        return _served(docs, spark.createDataFrame([], columns), id_col)
    terms = query_terms(query[:QUERY_CHARS])
    more = [(c, "boolean") for c in ("file_checked", "dir_checked", "full_file")] + [(f"{p}_{x}", "double") for p in ("now", "dir_now") for x in ("mtime", "size", "ctime")]
    whole = docs
    for c, t in more:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(False if t == "boolean" else None).cast(t))
    key = [F.col("source"), F.coalesce("command", F.lit("")).alias("__command")]
    newest = docs.where((F.col("workspace") == F.lit(workspace)) & (F.col("workspace") != "")).groupBy(*key)
    newest = newest.agg(F.max_by(id_col, F.struct("last_ref", -F.col("seq"))).alias("__newest"))

    # one pass over the texts: what the scores need of each row that is found or has a term
    scope = docs.where(in_scope(workspace))
    some = scope if index is None and grams is None else candidates(scope, index, query, id_col, grams)
    counted = index is None and grams is None
    rows = some.withColumn("__folded", text.fold_ascii(F.lower("content"))) if terms else some
    rows = rows.withColumn("__at", found_at(F.col("content"), query))
    has_term = first_place(F.col("__folded"), terms) > 0 if terms and counted else F.lit(False)
    tf = [F.least(F.lit(3), ((F.length("__folded") - F.length(F.replace(F.col("__folded"), F.lit(t), F.lit("")))) / len(t)).cast("int")) for t in terms]
    has = F.array(*(is_token(F.col("__folded"), t) for t in terms)) if terms and counted else F.lit(None).cast("array<boolean>")
    slim = rows.where((F.col("__at") > 0) | has_term).select(
        *(F.col(c) for c in docs.columns if c != "content"), (F.array(*tf) if terms else F.lit(None).cast("array<int>")).alias("__tf"), has.alias("__has"), "__at", F.length("content").alias("__chars")
    )
    slim = stored(slim, "recall-hits")
    hits = slim.where("__at > 0").withColumn("__command", F.coalesce("command", F.lit(""))).join(newest, ["source", "__command"], "left")
    plain = scores.relevance_of([F.col("__tf")[i] for i in range(len(terms))], terms) if terms else F.lit(0.0)
    relevance = plain
    if terms and (counted or index is not None):
        n_docs = scope.agg(F.count("*").alias("__n"))
        if counted:
            named = slim.agg(*(F.count_if(F.col("__has")[i]).alias(f"__df{i}") for i in range(len(terms))))
        else:
            own = index.where(F.col("term").isin(*terms)).join(scope.select(F.col(id_col).alias("id")), "id", "left_semi")
            named = own.agg(*(F.count_if(F.col("term") == t).alias(f"__df{i}") for i, t in enumerate(terms)))
        hits = hits.crossJoin(F.broadcast(n_docs.crossJoin(named)))  # one row
        weight = [F.when(F.col(f"__df{i}") > 0, idf_value(F.col(f"__df{i}"), F.col("__n"))).otherwise(0.0) for i in range(len(terms))]
        raw = sum((F.col("__tf")[i] * w for i, w in enumerate(weight)), F.lit(0.0))
        most = F.greatest(F.lit(0.01), F.lit(0.0), *weight) * len(terms) * 3
        relevance = F.when(F.col("__n") >= IDF_LEAST_DOCS, F.least(F.lit(1.0), raw / most)).otherwise(plain)
    later = F.coalesce(F.col("__newest") != F.col(id_col), F.lit(False))
    hours = (now - F.coalesce("content_at", F.col("created_at").cast("double"), now.cast("double"))) / 3_600_000
    proven = F.col("source").isin("read_file", "shell_command") & F.col("file_mtime").isNotNull()
    room = F.floor(F.when(proven | (hours < 1), budget).when(hours < 24, F.floor(F.lit(budget * 0.75))).otherwise(F.floor(F.lit(budget * 0.5))))
    scored = hits.select(
        F.col(id_col).alias("id"), "seq", F.round(relevance, 9).alias("relevance"), scores.confidence(workspace, now, later).alias("c"),
        F.col("__at").alias("at"), room.alias("room"), (F.coalesce("full_file", F.lit(False)) & (F.col("__chars") <= FULL_CHARS) & F.lit(full_content)).alias("whole"),
    )
    scored = stored(scored.select("*", F.col("c.score").alias("confidence"), F.col("c.stale").alias("stale")), "recall-scores")  # read for both orders
    fresh = scored.where(~F.col("stale")).select("id", "seq", "relevance", "confidence", "at", "room", "whole")
    best = fused_top(fresh, [("relevance", True) if mode == "relevance" else ("seq", False), ("confidence", True)], limit)
    old = scored.where("stale").orderBy(F.desc("confidence"), "id").limit(limit)
    names = [c.split()[0] for c in columns.split(", ")]
    found = best.withColumn("stale", F.lit(False)).withColumn("reason", F.lit(None).cast("string")).select(*names).unionByName(
        old.withColumn("rrf", F.lit(None).cast("double")).withColumn("reason", scores.stale_reason("c.flags")).select(*names)
    )
    ranked = found.collect()  # at most twice ``limit`` short rows
    drop_stored(slim, scored)
    return _served(whole, spark.createDataFrame(ranked, columns), id_col, [r.id for r in ranked])


def _served(docs: DataFrame, found: DataFrame, id_col: str, ids: list | None = None) -> DataFrame:
    """The texts of the rows that were found: their ids reach the scan as a filter."""
    own = docs.where(F.col(id_col).isin(ids or [])).select(F.col(id_col).alias("id"), "content")
    full = own.join(F.broadcast(found), "id")  # at most twice the limit
    body = F.when(F.col("whole"), F.col("content")).otherwise(snippet(F.col("content"), F.col("at"), F.col("room")))
    return full.select("id", "rrf", "relevance", "confidence", "stale", "reason", F.when(~F.col("stale"), body).alias("snippet"), text.blob_ref("id", "content").alias("ref"))


def recall_meter(served: DataFrame) -> DataFrame:
    """One row of counters of a recall's result: ``served, dropped, injected`` (characters of what was served)."""
    return served.agg(
        F.count_if(~F.col("stale")).alias("served"), F.count_if("stale").alias("dropped"), F.coalesce(F.sum(F.length("snippet")), F.lit(0)).alias("injected")
    )


def find_symbol(blobs: DataFrame, name: str, path: str | None = None, limit: int = 5) -> DataFrame:
    """Definitions of a name in stored files, the most recent first.  Files without the name do not reach
    Python."""
    from ..functions.pyudf import symbol

    own = blobs.where(F.col("content").contains(name))
    if path is not None:
        own = own.where(F.col("file_path").contains(path))
    found = own.select("hash", "file_path", "last_ref", symbol(name)(F.col("content")).alias("definition"))
    return found.where("definition is not null").orderBy(F.desc("last_ref"), "hash").limit(limit)
