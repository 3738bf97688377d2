"""SQL for the registered queries, written for DuckDB and independent of the operators' plans.

Patterns are shared as constants; look-arounds at ASCII words become ``\\b``, which is ASCII there.
"""

from __future__ import annotations

from ..functions import commitments, detect, language, redact, reduce, rules
from .catalog import BLOCK_TERMS, COMMANDS, FEW_TERMS, FRESH_NOW, KINDS, NOW, PATTERN, PATTERN_TERMS, PATTERNS, QUERY, RECALL_PATTERN, TRACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    for a in ("(?<![A-Za-z0-9_])", "(?<![a-z0-9_])", "(?![A-Za-z0-9_])", "(?![a-z0-9_])"):
        p = p.replace(a, r"\b")
    return q(p)


def found(c: str, p: str) -> str:
    return f"regexp_matches({c}, {re2(p)})"


def any_found(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(found(c, p) for p in patterns) + ")"


def fold(c: str) -> str:
    return f"replace(replace(replace(strip_accents(lower({c})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


SPLIT_LINES = "string_split({0}, chr(10))"


def split(c: str) -> str:
    return SPLIT_LINES.format(c)


TERMS = [t for t in QUERY.split() if t not in language.words_of()]
ATOMS = f"""
  w AS (SELECT doc_id, unnest(string_split_regex({fold("text")}, '\\s+')) AS atom FROM documents),
  tok AS (SELECT DISTINCT doc_id, term FROM (
    SELECT doc_id, atom AS term FROM w WHERE atom <> ''
    UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(string_split_regex(atom, '[_./\\\\-]+')) AS p FROM w) WHERE length(p) >= 3))"""

_age = "CASE WHEN age < 300000 THEN 20 WHEN age < 3600000 THEN 5 WHEN age < 14400000 THEN -10 WHEN age < 86400000 THEN -40 ELSE -55 END"


def _tf(t: str) -> str:
    return f"least(3, (length(f) - length(replace(f, '{t}', ''))) // {len(t)})"


_idf = lambda t: f"ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5))"

def recall(found: str, place: str, terms: list[str], also: str = "") -> str:
    """The best 20 fresh and the first 20 stale documents; ``found``: whether a document is found, ``place``: where,
    ``also``: what else a document must have.  Frequencies are those of the workspace's own documents."""
    weight = lambda t: f"CASE WHEN df_{t} > 0 THEN {_idf(t)} ELSE 0 END"
    return f"""
WITH {ATOMS},
  a AS (SELECT doc_id, text, {fold("text")} AS f, lower(text) AS l, (doc_id % 2000) * 60000 AS age,
    CASE WHEN doc_id % 10 = 7 THEN 'edit_file' WHEN doc_id % 2 = 0 THEN 'shell_command' ELSE 'web_fetch' END AS source,
    CASE WHEN doc_id % 4 = 0 THEN 'git status ' ELSE 'ls ' END || (doc_id % 300) AS command,
    CASE WHEN doc_id % 11 = 5 THEN NULL WHEN doc_id % 3 = 0 THEN 'other' ELSE 'here' END AS workspace FROM documents),
  o AS (SELECT doc_id FROM a WHERE workspace = 'here' AND source <> 'edit_file'),
  s AS (SELECT (SELECT count(*) FROM o) AS n, {", ".join(f"(SELECT count(*) FROM tok JOIN o USING (doc_id) WHERE term = '{t}') AS df_{t}" for t in terms)}),
  nw AS (SELECT source, command, first(doc_id ORDER BY age, doc_id) AS newest FROM a WHERE workspace = 'here' GROUP BY source, command),
  d AS (SELECT a.*, doc_id <> newest AS later FROM a JOIN nw USING (source, command) WHERE workspace = 'here' AND source <> 'edit_file' AND text IS NOT NULL {also}),
  h AS (SELECT doc_id, text, age, later,
    round(least(1.0, ({" + ".join(f"{_tf(t)} * {weight(t)}" for t in terms)}) / (greatest(0.01, {", ".join(map(weight, terms))}) * {3 * len(terms)})), 9) AS relevance,
    {place} AS place_at, source = 'shell_command' AND doc_id % 8 = 2 AS proven,
    CASE WHEN source = 'web_fetch' THEN CASE WHEN age < 120000 THEN 10 WHEN age < 900000 THEN -15 ELSE -35 END
         WHEN doc_id % 8 = 2 THEN CASE WHEN doc_id % 16 = 2 THEN 40 ELSE -60 END
         WHEN doc_id % 4 = 0 THEN CASE WHEN age < 300000 THEN 5 WHEN age < 1800000 THEN -10 ELSE -25 END ELSE 0 END AS proof
    FROM d, s WHERE {found}),
  k AS (SELECT *, greatest(0, least(100, 75 + proof + CASE WHEN proven THEN 0 ELSE {_age} END - CASE WHEN later THEN 30 ELSE 0 END)) AS confidence FROM h),
  r AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, doc_id) AS ra, row_number() OVER (ORDER BY confidence DESC, doc_id) AS rb FROM k WHERE confidence >= 40),
  b AS (SELECT *, round(1.0 / (60 + ra) + 1.0 / (60 + rb), 9) AS rrf FROM r ORDER BY rrf DESC, doc_id LIMIT 20),
  m AS (SELECT *, CASE WHEN proven OR age < 3600000 THEN 2000 WHEN age < 86400000 THEN 1500 ELSE 1000 END AS room FROM b)
SELECT doc_id, round(rrf, 6) AS rrf, round(relevance, 6) AS relevance, cast(confidence AS bigint) AS confidence, false AS stale, NULL AS reason,
  CASE WHEN length(text) <= room THEN text ELSE substr(text, least(greatest(1, place_at - room // 2), length(text) - room + 1), room) END AS snippet FROM m
UNION ALL
(SELECT doc_id, NULL, round(relevance, 6), cast(confidence AS bigint), true,
  CASE WHEN proof = -60 THEN 'file modified' WHEN later THEN 'superseded' ELSE 'too old' END, NULL FROM k WHERE confidence < 40 ORDER BY confidence DESC, doc_id LIMIT 20)
"""


WORDS = QUERY.lower().split()
_any_word = " OR ".join(f"contains(l, {q(w)})" for w in WORDS)
_first_word = f"coalesce({', '.join(f'nullif(strpos(l, {q(w)}), 0)' for w in WORDS)})"
RECALL = recall(_any_word, _first_word, TERMS)
RECALL_INDEXED = recall(_any_word, _first_word, TERMS, f"AND doc_id IN (SELECT doc_id FROM tok WHERE term IN ({', '.join(map(q, WORDS))}))")
_pattern = q("(?i)" + RECALL_PATTERN)
RECALL_PATTERNED = recall(f"regexp_matches(text, {_pattern})", f"strpos(text, regexp_extract(text, {_pattern}))", PATTERN_TERMS)

_hash = "sha256({0})"
_files = """
  d AS (SELECT *, source || '/' || (doc_id % 50) || '.txt' AS p FROM documents),
  l AS (SELECT p, max(doc_id) AS id FROM d GROUP BY p),
  snap AS (SELECT l.p, l.id AS mtime, d.n_chars + CASE WHEN l.id % 4 = 0 THEN 1 ELSE 0 END AS size FROM l JOIN d ON d.doc_id = l.id WHERE l.id % 9 <> 0)"""

FRESH = f"""
WITH e AS (SELECT *, event_id % 11 AS k, CASE event_type WHEN 'click' THEN 'read_file' WHEN 'error' THEN 'read_file' WHEN 'purchase' THEN 'web_search' ELSE 'shell_command' END AS source,
    {FRESH_NOW} - epoch_us(ts) // 1000 AS age, event_id % 5 < 3 AS checked, event_id % 13 = 0 AS edited, event_id % 17 = 0 AS old FROM events),
  m AS (SELECT *, CASE WHEN k <> 3 THEN value END AS mtime, CASE WHEN k <> 3 THEN k END AS size, CASE WHEN k <> 4 THEN 1 END AS ct,
    CASE WHEN k = 5 THEN NULL WHEN k = 6 THEN value + 1 ELSE value END AS n_mtime, k AS n_size, CASE WHEN k = 7 THEN 2 WHEN k <> 8 THEN 1 END AS n_ct FROM e),
  f AS (SELECT *, n_mtime IS NOT DISTINCT FROM mtime AS same_m, n_mtime IS NOT DISTINCT FROM mtime AND n_size IS NOT DISTINCT FROM size AS same, ct IS NOT NULL AND n_ct IS NOT NULL AS both_, coalesce(ct = n_ct, false) AS same_c FROM m),
  p AS (SELECT *,
    CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN -70 ELSE 25 END AS place_p, CASE WHEN k = 0 THEN 'no workspace' WHEN k = 1 THEN 'other workspace' END AS place_f,
    CASE WHEN source = 'read_file' AND k <> 2 THEN
           CASE WHEN NOT checked THEN CASE WHEN edited THEN 'edited by model' ELSE 'read_file (unverified)' END
                WHEN n_mtime IS NULL THEN 'file deleted'
                WHEN mtime IS NOT NULL AND size IS NOT NULL THEN CASE WHEN NOT same THEN 'file modified' WHEN both_ AND same_c THEN 'file unchanged' WHEN both_ THEN 'file metadata changed' ELSE 'file freshness unverified' END
                WHEN edited THEN 'edited by model' ELSE 'read_file (unverified)' END
         WHEN source = 'shell_command' AND checked THEN
           CASE WHEN n_mtime IS NULL THEN 'file deleted'
                WHEN mtime IS NOT NULL THEN CASE WHEN NOT same_m THEN 'file modified' WHEN both_ AND same_c THEN 'file unchanged' WHEN both_ THEN 'file metadata changed' ELSE 'file freshness unverified' END
                WHEN edited THEN 'edited by model' ELSE 'command (unverified)' END
         WHEN source = 'read_file' THEN NULL
         WHEN source = 'web_search' THEN 'web result of a while ago'
         WHEN k % 2 = 0 THEN 'git state of a while ago' ELSE 'command (age only)' END AS proof_f FROM f),
  s AS (SELECT *, CASE WHEN proof_f = 'file unchanged' THEN 40 WHEN proof_f IN ('file deleted', 'file modified', 'file metadata changed', 'file freshness unverified', 'edited by model') THEN -60
           WHEN proof_f LIKE 'web%' THEN CASE WHEN age < 120000 THEN 10 WHEN age < 900000 THEN -15 ELSE -35 END
           WHEN proof_f LIKE 'git%' THEN CASE WHEN age < 300000 THEN 5 WHEN age < 1800000 THEN -10 ELSE -25 END ELSE 0 END AS proof_p,
    CASE WHEN source IN ('read_file', 'shell_command') AND mtime IS NOT NULL THEN 0 ELSE {_age} END AS age_p FROM p),
  t AS (SELECT *, greatest(0, least(100, 50 + place_p + proof_p + age_p - CASE WHEN old THEN 30 ELSE 0 END)) AS score FROM s)
"""

_usage = "u AS (SELECT cast(user_id AS varchar) AS session, event_id AS turn, user_id, cast(round(value * 100) AS bigint) AS i, cast(round(value * 10) AS bigint) AS o, cast(floor(cast(round(value * 100) AS bigint) * (event_id % 4) / 4) AS bigint) AS cr FROM events)"

_segs = """
  a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g') AS m FROM documents WHERE length(text) >= 2000),
  b AS (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split(m, chr(1)), lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: length(x) >= 12),
    lambda x: CASE WHEN length(x) > 500 THEN left(x, 500) || '…' ELSE x END) AS ss FROM a)"""
_salience = f"(CASE WHEN {found('s', reduce.TROUBLE)} THEN 3 ELSE 0 END + CASE WHEN {found('s', reduce.CAPITALS)} THEN 1 ELSE 0 END + CASE WHEN {found('s', reduce.DOTTED)} THEN 1 ELSE 0 END + CASE WHEN {found('s', reduce.NUMBER)} THEN 1 ELSE 0 END)"
CRUSH = f"""
WITH {_segs},
  e AS (SELECT doc_id, text, len(ss) AS n, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM b WHERE len(ss) > 8),
  f AS (SELECT *, {_salience} + CASE WHEN i < 2 OR i >= n - 2 THEN 2 ELSE 0 END AS score FROM e),
  g AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY score DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
  h AS (SELECT doc_id, any_value(text) AS text, any_value(n) AS n, count(*) AS kept, string_agg(s, chr(10) ORDER BY i) AS t FROM g
        WHERE before < ceil(length(text) * 0.5) OR {any_found('s', reduce.FORCED)} GROUP BY doc_id),
  j AS (SELECT * FROM h WHERE length(t) < length(text))
SELECT d.doc_id, j.doc_id IS NOT NULL AS crushed, cast(coalesce(j.n, 0) AS bigint) AS segments_before, cast(coalesce(j.kept, 0) AS bigint) AS segments_after, sha256(coalesce(j.t, d.text)) AS sha
FROM documents d LEFT JOIN j USING (doc_id)
"""

_lang_counts = ", ".join(f"len(list_filter(ws, lambda w: w IN {in_list(s.split())})) AS {lang}" for lang, s in language.STOPWORDS.items())
LANG = f"""
  lw AS (SELECT doc_id, text, regexp_extract_all({fold("text")}, '[a-z'']+') AS ws FROM documents),
  lc AS (SELECT doc_id, text, {_lang_counts}, CASE WHEN regexp_matches(text, '(?i)[àâäéèêëîïôöùûüçœæ]') THEN 1 ELSE 0 END AS accent FROM lw),
  lr AS (SELECT doc_id, text, fr, en, es, de, list_sort([{{'n': -(fr + accent), 'i': 0, 'l': 'fr'}}, {{'n': -en, 'i': 1, 'l': 'en'}}, {{'n': -es, 'i': 2, 'l': 'es'}}, {{'n': -de, 'i': 3, 'l': 'de'}}]) AS r FROM lc),
  ll AS (SELECT doc_id, text, fr, en, es, de, CASE WHEN text IS NULL OR length(text) < 40 OR r[1].n = 0 THEN 'unknown' WHEN -r[1].n > -r[2].n * 1.5 THEN r[1].l ELSE 'mixed' END AS language FROM lr)"""

_stop = " OR ".join(f"(lang = {q(k)} AND folded IN {in_list(language.words_of(None, k))})" for k in language.STOPWORDS)
PROSE = f"""
WITH {LANG},
  x AS (SELECT doc_id, text, language AS lang, unnest({split("text")}) AS line, generate_subscripts({split("text")}, 1) - 1 AS li FROM ll WHERE length(text) >= 500),
  y AS (SELECT *, trim(line) <> '' AND ((regexp_matches(line, '^[ \\t]{{2,}}') AND regexp_matches(trim(line), '[=;{{}}()\\[\\],<>]')) OR regexp_matches(trim(line), '[;{{}}\\[\\]()<>]$')
        OR regexp_matches(trim(line), {q("^(?:" + reduce._CODE_WORDS + r")(?:[^A-Za-z0-9_]|$)")}) OR regexp_matches(trim(line), '=>|===|!==')) AS code FROM x),
  z AS (SELECT doc_id, lang, li, code, unnest(CASE WHEN code THEN [line] ELSE regexp_extract_all(line, '[ \\t\\r\\f]+|[^ \\t\\r\\f]+') END) AS w,
        generate_subscripts(CASE WHEN code THEN [line] ELSE regexp_extract_all(line, '[ \\t\\r\\f]+|[^ \\t\\r\\f]+') END, 1) - 1 AS i FROM y),
  z2 AS (SELECT *, code OR NOT regexp_matches(w, '^[ \\t\\r\\f]') AS word FROM z),
  z3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, li, word ORDER BY i) - 1 AS wi, count(*) OVER (PARTITION BY doc_id, li, word) AS words, regexp_replace(lower(w), '^[^\\pL]+|[^\\pL]+$', '', 'g') AS bare FROM z2),
  z4 AS (SELECT *, {fold("bare")} AS folded FROM z3),
  z5 AS (SELECT *, NOT code AND word AND wi >= 3 AND wi < words - 3 AND bare <> '' AND ({_stop} OR (lang NOT IN {in_list(list(language.STOPWORDS))} AND folded IN {in_list(language.words_of())}))
        AND folded NOT IN {in_list(language.NEGATIONS)} AND NOT {any_found("bare", language.PROTECTED)} AND NOT regexp_matches(w, '^["''`]|["''`]$') AS dropped FROM z4),
  k AS (SELECT doc_id, count(*) FILTER (word) AS total, count(*) FILTER (dropped) AS nd FROM z5 GROUP BY doc_id),
  r AS (SELECT z5.*, k.total, k.nd, greatest(0, nd - cast(floor(total * (1 - 0.65)) AS bigint)) AS need, row_number() OVER (PARTITION BY z5.doc_id, dropped ORDER BY -length(w), li, i) AS place FROM z5 JOIN k USING (doc_id)),
  o AS (SELECT doc_id, li, string_agg(CASE WHEN NOT dropped OR place <= need THEN w ELSE '' END, '' ORDER BY i) AS line FROM r GROUP BY doc_id, li),
  t AS (SELECT y.doc_id, any_value(y.text) AS text, string_agg(coalesce(o.line, ''), chr(10) ORDER BY y.li) AS t FROM y LEFT JOIN o ON o.doc_id = y.doc_id AND o.li = y.li GROUP BY y.doc_id),
  g AS (SELECT t.doc_id, t.t, k.total, k.nd, greatest(0, k.nd - cast(floor(k.total * (1 - 0.65)) AS bigint)) AS need FROM t JOIN k USING (doc_id) WHERE length(t.t) * 10 <= length(t.text) * 9)
SELECT d.doc_id, g.doc_id IS NOT NULL AS was_compressed, CASE WHEN d.text IS NULL OR length(d.text) < 500 THEN 'unknown' ELSE ll.language END AS lang, coalesce(g.total, 0) AS words, coalesce(g.nd, 0) AS dropped,
  cast(coalesce(g.need, 0) AS bigint) AS restored, sha256(coalesce(g.t, d.text)) AS sha FROM documents d JOIN ll USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def _redact_sql() -> str:
    text, out, step = "text", [], []
    for k, p in redact.PATTERNS.items():
        name = k.replace("-", "_")
        gate = f"regexp_matches(t, {q(redact._HINT)})" if k == "kv" else "true"
        step.append((name, re2(p), gate, redact.mark(k)))
        out.append(name)
    sql, before = "WITH s0 AS (SELECT doc_id, text AS t FROM documents)", "s0"
    for n, (name, p, gate, mark) in enumerate(step, 1):
        carried = "".join(f", {x}" for x in out[:n - 1])
        sql += f",\n s{n} AS (SELECT doc_id{carried}, CASE WHEN {gate} THEN len(regexp_extract_all(t, {p})) ELSE 0 END AS {name}, CASE WHEN {gate} THEN regexp_replace(t, {p}, '{mark}', 'g') ELSE t END AS t FROM {before})"
        before = f"s{n}"
    return sql + f"\nSELECT doc_id, {', '.join(out)} FROM {before}"


BREAKER = """
WITH s AS (SELECT user_id, list(event_type IN ('error', 'click') ORDER BY event_id) AS f FROM events GROUP BY user_id),
  r AS (SELECT user_id, list_reduce(f, lambda s, bad: CASE
    WHEN s.state = 'open' AND s.turns + 1 >= 5 THEN {'state': 'half-open', 'failures': s.failures, 'turns': 0, 'opened': s.opened}
    WHEN s.state = 'open' THEN {'state': 'open', 'failures': s.failures, 'turns': s.turns + 1, 'opened': s.opened}
    WHEN bad AND (s.state = 'half-open' OR s.failures + 1 >= 3) THEN {'state': 'open', 'failures': s.failures + 1, 'turns': 0, 'opened': s.opened + 1}
    WHEN bad THEN {'state': 'closed', 'failures': s.failures + 1, 'turns': 0, 'opened': s.opened}
    ELSE {'state': 'closed', 'failures': 0, 'turns': 0, 'opened': s.opened} END,
    {'state': 'closed', 'failures': 0, 'turns': 0, 'opened': 0}) AS s FROM s)
SELECT user_id, s.state AS state, cast(s.failures AS bigint) AS failures, cast(s.opened AS bigint) AS opened FROM r
"""

NUMBERED = r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = doc_id % 3 THEN x ELSE i || ': ' || x END) AS a FROM documents),
  k AS (SELECT doc_id, a, len(list_filter(a, lambda x: regexp_matches(x, '^\s*\d+: '))) AS own, len(list_filter(a, lambda x: trim(x) <> '')) AS n FROM l)
SELECT doc_id, sha256(array_to_string(CASE WHEN n > 0 AND own * 2 >= n THEN list_transform(a, lambda x: regexp_replace(x, '^\s*\d+: ', '')) ELSE a END, chr(10))) AS sha FROM k
"""

BINARY = r"""
WITH t AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN regexp_replace(base64(encode(text)), '(.{76})', '\1' || chr(10), 'g') ELSE text END, '') AS t FROM documents),
  s AS (SELECT doc_id, t, left(t, 8192) AS s, list_filter(string_split(t, chr(10)), lambda x: length(x) >= 8 AND trim(x) <> '') AS a FROM t)
SELECT doc_id, t <> '' AND (contains(s, chr(0)) OR (length(s) - length(regexp_replace(s, '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / greatest(length(s), 1) > 0.1
  OR (NOT (regexp_matches(s, '</?[a-z][\s\S]{0,200}?>') OR regexp_matches(s, 'https?://\S+') OR regexp_matches(s, '(?m)^#+\s') OR regexp_matches(s, '[\x{00C0}-\x{017F}]'))
    AND len(a) >= 3 AND len(list_filter(a, lambda x: NOT regexp_matches(trim(x), '^[A-Za-z0-9+/=]+$'))) = 0)) AS is_binary FROM s
"""

_bl = "[ \\t\\r\\n]+"
_strip = lambda x: f"regexp_replace({x}, '^{_bl}|{_bl}$', '', 'g')"
TYPES = f"""
WITH e AS (SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'event', event_id, props FROM events),
  l AS (SELECT origin, id, unnest({split("text")}) AS line FROM e),
  m AS (SELECT origin, id, line, {_strip("line")} AS t FROM l),
  v AS (SELECT origin, id, count(*) AS n, count(*) FILTER ({any_found("t", detect._LOG)}) AS log, count(*) FILTER ({found("line", detect._SEARCH)}) AS search,
     count(*) FILTER (NOT {any_found("t", detect._FRAME)} AND ({found("t", detect._CODE_START)} OR ({found("t", "[{};]$")} AND {found("t", "[=()]")}) OR ({found("line", "^[ \\t]{2,}")} AND {found("t", "[=;{}()\\[\\],<>]")}))) AS code
     FROM m WHERE t <> '' GROUP BY origin, id),
  j AS (SELECT e.origin, e.id, {_strip("text")} AS s, text, coalesce(v.n, 0) AS n, coalesce(log, 0) AS log, coalesce(search, 0) AS search, coalesce(code, 0) AS code FROM e LEFT JOIN v USING (origin, id)),
  k AS (SELECT *, CASE WHEN text IS NULL OR s = '' THEN 'text' WHEN regexp_matches(s, '^[\\[{{]') AND json_valid(s) THEN 'json' WHEN {found("s", detect._DIFF)} THEN 'diff' WHEN n = 0 THEN 'text'
     WHEN log * 2 >= n THEN 'log' WHEN search * 10 >= n * 3 THEN 'search' WHEN code * 10 >= n * 3 THEN 'code' ELSE 'text' END AS type FROM j)
SELECT origin, id, type, round(CASE type WHEN 'json' THEN CASE WHEN s LIKE '[%' THEN 0.9 ELSE 0.8 END WHEN 'diff' THEN 0.85 WHEN 'log' THEN least(1.0, 0.5 + log / n * 0.5) WHEN 'search' THEN least(1.0, 0.4 + search / n * 0.6)
    WHEN 'code' THEN least(1.0, 0.5 + code / n * 0.5) ELSE 0.5 END, 6) AS confidence, CASE WHEN type = 'json' THEN 'json' WHEN type = 'log' THEN 'stacktrace' WHEN type IN ('search', 'diff', 'code') THEN 'digest' ELSE 'prose' END AS route,
  log, search, code, n FROM k
"""

_dots = r"regexp_replace(text, '[.] ', '.' || chr(10), 'g')"
_log_line = "strftime(ts, '%H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || ' user ' || (user_id % 3) || ' ' || event_type || ' took ' || cast(floor(value) AS bigint) || ' ms'"
LOGS = f"""
WITH l AS (SELECT user_id, event_id, {_log_line} AS line FROM events),
  c AS (SELECT user_id, count(*) AS n, string_agg(line, chr(10) ORDER BY event_id) AS whole FROM l GROUP BY user_id),
  m AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, NOT {found("line", reduce.KEPT_LOG_LINE)} AND length(trim(line)) >= 8 AND {any_found("line", reduce.HAS_FIGURE)} AS tpl FROM l),
  k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, 'v?[0-9]+\\.[0-9]+(?:\\.[0-9]+)?(?:[-+][A-Za-z0-9_.]+)?', '#', 'g'), '(^|[^A-Za-z])[0-9]+(?:\\.[0-9]+)*', '\\1#', 'g'), '(^|[^A-Za-z])[0-9a-fA-F]{{6,}}', '\\1#', 'g') AS key FROM m),
  g AS (SELECT user_id, key, count(*) AS n, min(pos) AS first FROM k WHERE tpl GROUP BY user_id, key),
  o AS (SELECT user_id, pos AS p, 0 AS part, line AS shown FROM k WHERE NOT tpl UNION ALL SELECT user_id, first, 1, CASE WHEN n > 1 THEN key || ' (×' || n || ')' ELSE key END FROM g),
  t AS (SELECT user_id, string_agg(shown, chr(10) ORDER BY part, p) AS t, count(*) FILTER (part = 1) AS templates FROM o GROUP BY user_id)
SELECT user_id, sha256(CASE WHEN n >= 8 AND templates > 0 AND length(t) < length(whole) THEN t ELSE whole END) AS sha, CASE WHEN n >= 8 THEN templates ELSE 0 END AS templates,
  n >= 8 AND templates > 0 AND length(t) < length(whole) AS collapsed FROM t JOIN c USING (user_id)
"""

DIGEST = f"""
WITH d AS (SELECT doc_id, text, ['shell_command', 'grep', 'read_file'][doc_id % 3 + 1] AS tool, ['ls -l', 'cat x.txt', 'npm test', 'echo hi'][doc_id % 4 + 1] AS cmd, {split("text")} AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
  s AS (SELECT *, CASE WHEN line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY p) OR p = 1 THEN 1 ELSE 0 END AS new FROM l),
  i AS (SELECT doc_id, line, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
  r AS (SELECT doc_id, g, any_value(line) AS line, count(*) AS n FROM i GROUP BY doc_id, g),
  dd AS (SELECT doc_id, string_agg(CASE WHEN n > 1 THEN line || ' (×' || n || ')' ELSE line END, chr(10) ORDER BY g) AS t FROM r GROUP BY doc_id),
  er AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({found("line", rules.FAILURE)}) AS k, string_agg(CASE WHEN {found("line", rules.FAILURE)} THEN line END, chr(10) ORDER BY p) AS t FROM l GROUP BY doc_id),
  gm AS (SELECT doc_id, count(*) FILTER ({found("line", rules.MATCH_LINE)}) AS k FROM l GROUP BY doc_id),
  x AS (SELECT d.*, dd.t AS dt, er.n AS en, er.k AS ek, er.t AS et, gm.k AS gk FROM d LEFT JOIN dd USING (doc_id) LEFT JOIN er USING (doc_id) LEFT JOIN gm USING (doc_id)),
  z AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN doc_id % 19 = 0 THEN 'failure-focus'
      WHEN tool = 'shell_command' AND cmd <> 'cat x.txt' AND length(text) > 6000 THEN 'bash-squash' WHEN tool = 'grep' AND length(text) > 1500 AND gk > 0 THEN 'grep-group'
      WHEN tool IN ('shell_command', 'grep') AND dt <> text THEN 'dedup' WHEN tool = 'shell_command' AND cmd = 'npm test' AND ek > 0 AND ek < en THEN 'error-only' END AS rule FROM x)
SELECT doc_id, rule, cast(CASE rule WHEN 'bash-squash' THEN length(text) - length('[Bash: exit ?, ' || length(text) || ' chars output]' || chr(10) || left(array_to_string(ls[1:30], chr(10)), 2000))
  WHEN 'dedup' THEN length(text) - length(dt) WHEN 'error-only' THEN length(text) - length(et) ELSE 0 END AS bigint) AS saved_chars FROM z
"""

_safe = found("line", rules.SECURITY)
DIGEST_ARMS = f"""
WITH d AS (SELECT doc_id, doc_id % 5 AS arm, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
  x AS (SELECT doc_id, arm, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
  l AS (SELECT doc_id, arm, i, CASE arm WHEN 0 THEN ' M ' || x || i
      WHEN 1 THEN CASE WHEN i % 5 = 0 THEN 'added ' || i || ' packages' WHEN i % 7 = 0 THEN x || i || ' severity high' ELSE x || i END
      WHEN 2 THEN i || CASE WHEN i % 2 = 0 THEN ':1 info ' ELSE ':1 error ' END || x
      WHEN 3 THEN CASE WHEN i % 3 = 0 THEN '[' || i || '/9] ' || x ELSE x || i END
      ELSE CASE WHEN i % 60 = 1 THEN '+' ELSE ' ' END || x || i END AS line FROM x),
  n AS (SELECT *, {_safe} AS safe, CASE arm WHEN 2 THEN {any_found("line", rules.DIAGNOSTICS)} WHEN 3 THEN {any_found("line", rules.NOISE)} ELSE false END AS noise, (i - 1) // 60 AS block, (i - 1) % 60 AS o FROM l),
  m AS (SELECT *, max(o) OVER (PARTITION BY doc_id, block) AS context FROM n),
  g AS (SELECT doc_id, any_value(arm) AS arm, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n,
      string_agg(CASE WHEN i <= 30 THEN ltrim(line) END, chr(10) ORDER BY i) AS entries, string_agg(CASE WHEN i <= 30 THEN line END, chr(10) ORDER BY i) AS head,
      string_agg(CASE WHEN NOT safe AND {found("line", rules.INSTALLED)} THEN trim(line) END, chr(10) ORDER BY i) AS said, string_agg(CASE WHEN safe THEN trim(line) END, chr(10) ORDER BY i) AS risky,
      string_agg(CASE WHEN safe OR NOT noise THEN line END, chr(10) ORDER BY i) AS kept,
      string_agg(CASE WHEN o <= 30 THEN line END || CASE WHEN o = least(30, context) AND context > 30 THEN chr(10) || ' …[' || (context - 30) || ' context lines]' ELSE '' END, chr(10) ORDER BY i) AS patch
    FROM m GROUP BY doc_id),
  b AS (SELECT doc_id, arm, head, CASE WHEN arm = 0 THEN 'On branch main' || chr(10) || t ELSE t END AS t,
      CASE arm WHEN 0 THEN 'branch: main' || chr(10) || entries || CASE WHEN n > 30 THEN chr(10) || '[' || (n - 30) || ' more entries]' ELSE '' END
        WHEN 1 THEN CASE WHEN length(t) >= 300 THEN concat_ws(chr(10), said, risky) END
        WHEN 2 THEN CASE WHEN length(t) >= 300 THEN kept END WHEN 3 THEN CASE WHEN length(t) >= 400 THEN kept END
        ELSE CASE WHEN length(t) >= 600 THEN patch END END AS own FROM g),
  r AS (SELECT doc_id, t, CASE WHEN arm IN (1, 3, 4) AND length(t) > 6000 THEN 'bash-squash'
      WHEN length(own) < length(t) AND own <> '' THEN ['git-status', 'install-summary', 'diagnostics-strip', 'dev-noise-strip', 'diff-summary'][arm + 1] END AS rule,
      CASE WHEN arm IN (1, 3, 4) AND length(t) > 6000 THEN '[Bash: exit ?, ' || length(t) || ' chars output]' || chr(10) || left(head, 2000) ELSE own END AS own FROM b)
SELECT doc_id, rule, CASE WHEN rule IS NOT NULL THEN sha256(own) END AS sha, cast(CASE WHEN rule IS NOT NULL THEN length(t) - length(own) ELSE 0 END AS bigint) AS saved_chars FROM r
"""

_esc = {k: re2(v) for k, v in commitments.ATOMS.items()}
_atom = lambda k, least: f"list_distinct(list_filter(regexp_extract_all(text, {_esc[k]}), lambda x: length(x) >= {least})[1:40])"
COMMIT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, left(coalesce(text, ''), 500) AS r FROM documents),
  n AS (SELECT *, len(regexp_extract_all(lower(text), {re2(commitments.NEGATION)})) AS negation, len(regexp_extract_all(lower(r), {re2(commitments.NEGATION)})) AS kept_n,
     list_filter(list_transform(regexp_extract_all(text, {re2(commitments.ERROR_LINE)}, 1), lambda x: trim(x)), lambda x: length(x) >= 4)[1:40] AS e,
     {_atom("url", 8)} AS u, {_atom("version", 4)} AS v, {_atom("hash", 4)} AS h, {_atom("path", 4)} AS p FROM d)
SELECT doc_id, negation + len(e) + len(u) + len(v) + len(h) + len(p) AS total,
  least(negation, kept_n) + len(list_filter(e, lambda x: contains(regexp_replace(r, '\\s+', ' ', 'g'), regexp_replace(x, '\\s+', ' ', 'g')))) + len(list_filter(u, lambda x: contains(r, x))) + len(list_filter(v, lambda x: contains(r, x)))
    + len(list_filter(h, lambda x: contains(r, x))) + len(list_filter(p, lambda x: contains(r, x))) AS preserved,
  negation, len(e) AS error, len(u) AS url, len(v) AS version, len(h) AS hash, len(p) AS path FROM n
"""

_pts = "CASE WHEN turn % 80 > 60 THEN 2 WHEN turn % 80 > 35 THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "breaker_fold": BREAKER,
    "line_numbers_strip": NUMBERED,
    "binary_detect": BINARY,
    "recall_ranked": RECALL,
    "recall_indexed": RECALL_INDEXED,
    "recall_pattern": RECALL_PATTERNED,
    "recall_touch": f"SELECT doc_id, cast({NOW} AS bigint) AS last_ref FROM ({RECALL}) WHERE NOT stale UNION SELECT doc_id, cast({NOW} AS bigint) FROM documents WHERE doc_id % 2000 = 0",
    "path_lookup_many": """WITH t AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^?#]*)', 1)) AS term FROM pages),
        q AS (SELECT cast(page_id AS varchar) AS lookup FROM pages),
        x AS (SELECT DISTINCT lookup, page_id FROM q JOIN t ON term = lookup OR (lookup NOT IN (SELECT term FROM t) AND length(term) > length(lookup)
              AND (suffix(term, lookup) OR contains(string_split(term, '/')[-1], lookup))))
        SELECT lookup, count(*) AS pages, min(page_id) AS first FROM x GROUP BY lookup""",
    "term_hits": f"""WITH s AS (SELECT unnest([{", ".join(map(q, FEW_TERMS))}]) AS string)
        SELECT string, count(*) AS documents, cast(sum((length(t) - length(replace(t, string, ''))) // length(string)) AS bigint) AS occurrences, cast(sum(strpos(t, string)) AS bigint) AS places
        FROM (SELECT lower(text) AS t FROM documents), s WHERE contains(t, string) GROUP BY string""",
    "term_first": f"""SELECT doc_id, CASE {" ".join(f"WHEN contains(t, {q(x)}) THEN {q(x)}" for x in FEW_TERMS)} END AS term,
        coalesce(CASE {" ".join(f"WHEN contains(t, {q(x)}) THEN strpos(t, {q(x)})" for x in FEW_TERMS)} END, 0) AS at FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
    "interval_join": """WITH x AS (SELECT l_suppkey AS supplier, l_returnflag, date_diff('day', DATE '1970-01-01', cast(l_shipdate AS date)) AS a,
          date_diff('day', DATE '1970-01-01', cast(l_shipdate AS date)) + cast(floor(l_quantity) AS integer) AS b FROM lineitem)
        SELECT l.supplier, count(*) AS pairs, cast(sum(least(l.b, r.b) - greatest(l.a, r.a) + 1) AS bigint) AS days FROM x l JOIN x r
        ON l.supplier = r.supplier AND l.l_returnflag = 'R' AND r.l_returnflag = 'A' AND l.a <= r.b AND r.a <= l.b GROUP BY l.supplier""",
    "breaker_states": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type IN ('error', 'click') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        s AS (SELECT user_id, cast(0 AS bigint) AS i, 'closed' AS state, cast(0 AS bigint) AS failures, cast(0 AS bigint) AS turns, cast(0 AS bigint) AS opened, cast(NULL AS bigint) AS event_id FROM e WHERE i = 1
          UNION ALL
          SELECT e.user_id, e.i,
            CASE WHEN s.state = 'open' THEN CASE WHEN s.turns + 1 >= 5 THEN 'half-open' ELSE 'open' END
                 WHEN NOT bad THEN 'closed' WHEN s.state = 'half-open' OR s.failures + 1 >= 3 THEN 'open' ELSE 'closed' END,
            CASE WHEN s.state = 'open' THEN s.failures WHEN NOT bad THEN 0 ELSE s.failures + 1 END,
            CASE WHEN s.state = 'open' AND s.turns + 1 < 5 THEN s.turns + 1 ELSE 0 END,
            CASE WHEN s.state <> 'open' AND bad AND (s.state = 'half-open' OR s.failures + 1 >= 3) THEN s.opened + 1 ELSE s.opened END, e.event_id
          FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
        SELECT user_id, event_id, state, failures, opened FROM s WHERE i > 0""",
    "running_estimates": """WITH x AS (SELECT user_id, event_id, cast(floor(value * 4 + 1) AS bigint) AS a, cast(floor(value + event_id % 7 + 1) AS bigint) AS t FROM events),
        g AS (SELECT * FROM x WHERE a > 0 AND t > 0),
        w AS (SELECT user_id, event_id, row_number() OVER u AS samples, count(*) OVER f AS n, sum(a) OVER f AS sa, sum(t) OVER f AS st, sum(a * a) OVER f AS saa, sum(a * t) OVER f AS sat FROM g
              WINDOW u AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
        s AS (SELECT *, CASE WHEN n * saa - sa * sa > 0 THEN cast(n * sat - sa * st AS double) / cast(n * saa - sa * sa AS double) ELSE 0 END AS slope FROM w)
        SELECT user_id, event_id, samples, n AS fitted, round(slope, 6) AS slope, round(CASE WHEN n * saa - sa * sa > 0 THEN (st - slope * sa) / n ELSE 0 END + 1e-7, 4) AS intercept FROM s""",
    "snapshot_upsert": """SELECT sha256(text) AS hash, any_value(length(text)) AS size, min(doc_id) * 1000 AS created_at, max(doc_id) * 1000 AS last_ref, count(*) AS seen,
        coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 0), min(doc_id)) AS seq FROM documents GROUP BY sha256(text)""",
    "regex_indexed": " UNION ALL ".join(f"SELECT {q(p)} AS pattern, doc_id FROM documents WHERE regexp_matches(text, {q('(?i)' + p)})" for p in PATTERNS),
    "blockmax_topk": f"""
WITH w AS (SELECT doc_id, unnest(string_split_regex({fold("text")}, '\\s+')) AS term FROM documents),
  t AS (SELECT doc_id, term, least(3, count(*)) AS tf FROM w WHERE term IN {in_list(BLOCK_TERMS)} GROUP BY doc_id, term),
  f AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY term),
  s AS (SELECT doc_id, round(sum(tf * idf), 9) AS score FROM t JOIN f USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, round(score, 6) AS score FROM s""",
    "index_postings": f"WITH {ATOMS} SELECT doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM tok GROUP BY doc_id",
    "index_idf": f"WITH {ATOMS}, n AS (SELECT count(*) AS n FROM documents), c AS (SELECT term, count(*) AS df FROM tok GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM c, n",
    "index_query": f"WITH {ATOMS} SELECT doc_id, count(*) AS matches FROM tok WHERE term IN {in_list(QUERY.split() + ['that'])} GROUP BY doc_id",
    "path_lookup": """WITH t AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^?#]*)', 1)) AS term FROM pages)
        SELECT DISTINCT page_id FROM t WHERE term = '25' OR (NOT EXISTS (SELECT 1 FROM t WHERE term = '25') AND length(term) > 2 AND (suffix(term, '25') OR contains(string_split(term, '/')[-1], '25')))""",
    "recall_regex_topk": f"SELECT doc_id, doc_id * 7919 % 10007 AS last_ref FROM documents WHERE regexp_matches(text, '(?i){PATTERN}') ORDER BY last_ref DESC, doc_id LIMIT 10",
    "content_store_upsert": "SELECT sha256(text) AS hash, any_value(length(text)) AS size, min(doc_id) * 1000 AS created_at, max(doc_id) * 1000 AS last_ref, count(*) AS seen, coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 0), min(doc_id)) AS seq FROM documents GROUP BY sha256(text)",
    "supersede_antijoin": """WITH v AS (SELECT doc_id, source, doc_id - doc_id % 40 AS v, cast(n_chars % 5 AS varchar) AS h FROM documents),
      k AS (SELECT source, max(v) AS v, first(h ORDER BY v DESC, h DESC) AS h FROM v WHERE source IS NOT NULL GROUP BY source)
      SELECT doc_id, coalesce(v.v < k.v AND v.h <> k.h, false) AS superseded FROM v LEFT JOIN k USING (source)""",
    "invalidate_theta": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), e AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS edit FROM p WHERE page_id % 25 = 0)
        SELECT page_id, EXISTS (SELECT 1 FROM e WHERE rtrim(path, '/') = edit OR (page_id % 3 <> 0 AND (starts_with(path, edit || '/') OR starts_with(edit, rtrim(path, '/') || '/')))) AS edited FROM p""",
    "as_of_prior_version": """WITH w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_purchase FROM events)
        SELECT event_id, prior_purchase FROM w WHERE event_type = 'error'""",
    "prior_versions": "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS place FROM events) WHERE place <= 5",
    "best_version": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view') DESC, epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "evict_over_cap": f"""WITH e AS (SELECT event_id, cast(round(value * 100) AS bigint) AS size, epoch_us(ts) // 1000 AS t FROM events), s AS (SELECT sum(size) AS b, count(*) AS n FROM e),
        w AS (SELECT *, sum(size) OVER o - size AS before, row_number() OVER o AS rn FROM e WHERE {NOW} - t > 1800000 WINDOW o AS (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id FROM w, s WHERE b - before > 5000000 OR n - (rn - 1) > 2000""",
    "newest_per_command": "SELECT event_id, round(value) <> first_value(round(value)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS supplanted FROM events",
    "freshness_score": FRESH + "SELECT event_id, cast(score AS bigint) AS score, score < 40 AS stale FROM t",
    "freshness_flags": FRESH + """SELECT event_id, concat_ws('; ', place_f, proof_f, CASE WHEN old THEN 'superseded' END, CASE WHEN score < 40 THEN 'stale' END) AS flags,
        CASE WHEN score < 40 THEN CASE WHEN proof_f IN ('file deleted', 'file modified', 'file metadata changed', 'edited by model') THEN proof_f WHEN old THEN 'superseded' WHEN place_f = 'other workspace' THEN place_f ELSE 'too old' END END AS reason FROM t""",
    "content_type_detect": TYPES,
    "language_detect": f"WITH {LANG} SELECT doc_id, language, cast(fr AS bigint) AS fr, cast(en AS bigint) AS en, cast(es AS bigint) AS es, cast(de AS bigint) AS de FROM ll",
    "commitments_kept": COMMIT,
    "redact_counts": _redact_sql(),
    "char_entropy": "SELECT d.doc_id, coalesce(e.bits, CASE WHEN d.text IS NOT NULL THEN 0.0 END) AS bits FROM documents d LEFT JOIN (SELECT doc_id, round(entropy(c), 6) AS bits FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id) e USING (doc_id)",
    "token_estimate": f"""SELECT doc_id, cast(ceil((length(text) - len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{F900}}-\\x{{FAFF}}]'))) / 3.3 + len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{F900}}-\\x{{FAFF}}]'))) AS bigint) AS tokens,
        len({split("text")}) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS lines, '[blob:' || left(sha256(text), 12) || ':' || length(text) || ']' AS ref FROM documents""",
    "bigram_shingles": """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 1) AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) >= 2 THEN len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE len(w) END AS n FROM w""",
    "dedup_runs": f"""WITH d AS (SELECT doc_id, unnest({split(_dots)}) AS line, generate_subscripts({split(_dots)}, 1) AS p FROM documents),
        b AS (SELECT doc_id, line, p * 2 + k AS p FROM d, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR length(line) BETWEEN 1 AND 30),
        s AS (SELECT *, CASE WHEN line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY p) THEN 1 ELSE 0 END AS new FROM b), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
        r AS (SELECT doc_id, g, any_value(line) AS line, count(*) AS n FROM i GROUP BY doc_id, g), t AS (SELECT doc_id, string_agg(CASE WHEN n > 1 THEN line || ' (×' || n || ')' ELSE line END, chr(10) ORDER BY g) AS t FROM r GROUP BY doc_id)
        SELECT doc_id, sha256(t) AS sha, length(t) AS chars FROM documents LEFT JOIN t USING (doc_id)""",
    "log_template_collapse": LOGS,
    "group_squash": f"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\\. ', '.' || chr(10), 'g'), '\\n') AS ss FROM documents),
        l AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM d), m AS (SELECT doc_id, i, 'dir/f' || (i % 29) || '.ts' AS f, 'dir/f' || (i % 29) || '.ts:' || i || ':' || s AS line FROM l),
        c AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS chars, count(*) AS matches, count(DISTINCT f) AS all_files FROM m GROUP BY doc_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS rn, min(i) OVER (PARTITION BY doc_id, f) AS first FROM m), z AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS fr FROM k),
        o AS (SELECT doc_id, first, 0 AS o, ' ' || f || ':' AS t FROM z WHERE fr <= 21 AND rn = 1 UNION ALL SELECT doc_id, first, rn, ' ' || left(line, 200) FROM z WHERE fr <= 21 AND rn <= 3),
        b AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY first, o) AS body FROM o GROUP BY doc_id)
        SELECT doc_id, matches, least(21, all_files) AS shown_files, all_files, sha256('[Search results: ' || matches || ' matches in ' || least(21, all_files) || ' files]' || chr(10) || body) AS sha FROM b JOIN c USING (doc_id) WHERE chars > 1500""",
    "salient_crush": CRUSH,
    "prose_compress": PROSE,
    "table_compact": """WITH e AS (SELECT user_id, event_id, event_type, cast(round(value * 100) AS bigint) AS cents FROM events), n AS (SELECT user_id, count(*) AS n,
          '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '","cents":' || cents || ',"user_id":' || user_id || '}', ',' ORDER BY event_id) || ']' AS js,
          string_agg(event_id || ',' || event_type || ',' || cents || ',' || user_id, chr(10) ORDER BY event_id) AS body FROM e GROUP BY user_id),
        t AS (SELECT *, '[N=' || n || ']{event_id:int,event_type:str,cents:int,user_id:int}' || chr(10) || body AS t FROM n)
        SELECT user_id, n <= 500 AND length(t) < length(js) AS was_compacted, CASE WHEN n <= 500 AND length(t) < length(js) THEN n ELSE 0 END AS rows, cast(CASE WHEN n <= 500 AND length(t) < length(js) THEN 4 ELSE 0 END AS bigint) AS cols,
          sha256(CASE WHEN n <= 500 AND length(t) < length(js) THEN t ELSE js END) AS sha FROM t""",
    "digest_rules": DIGEST,
    "digest_arms": DIGEST_ARMS,
    "head_squash": f"""WITH t AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN '[' || length(text) || ' chars, ' || len({split("text")}) || ' lines]' || chr(10) || left(array_to_string({split("text")}[1:30], chr(10)), 2000) END AS t FROM documents)
        SELECT doc_id, sha256(t) AS sha, length(t) AS chars FROM t""",
    "keep_last_n": f"""WITH l AS (SELECT doc_id, CASE WHEN {split("text")}[-1] = '' THEN {split("text")}[:-2] ELSE {split("text")} END AS a FROM documents)
        SELECT doc_id, sha256(CASE WHEN len(a) > 3 THEN array_to_string(a[-3:], chr(10)) || chr(10) || '[' || (len(a) - 3) || ' more lines]' END) AS sha FROM l""",
    "line_window": f"""WITH l AS (SELECT doc_id, doc_id % 4 AS o, CASE WHEN {split("text")}[-1] = '' THEN {split("text")}[:-2] ELSE {split("text")} END AS a FROM documents),
        w AS (SELECT doc_id, o, a, list_transform(range(o, least(o + 3, len(a) + 1)), lambda i: i || ': ' || CASE WHEN length(regexp_replace(a[i], '\\r$', '')) > 2000 THEN left(regexp_replace(a[i], '\\r$', ''), 2000) || '… [' || (length(regexp_replace(a[i], '\\r$', '')) - 2000) || ' chars truncated]' ELSE regexp_replace(a[i], '\\r$', '') END) AS w FROM l)
        SELECT doc_id, sha256(CASE WHEN o >= 1 AND o <= len(a) THEN array_to_string(w, chr(10)) END) AS sha FROM w""",
    "mask_observations": f"""WITH m AS (SELECT conv_id, turn, role, text, length(text) AS n, role = 'assistant' AND turn % 5 <> 4 AS obs FROM conversations),
        i AS (SELECT *, sum(obs::int) OVER (PARTITION BY conv_id ORDER BY turn) AS i, sum(obs::int) OVER (PARTITION BY conv_id) AS t FROM m),
        v AS (SELECT *, CASE WHEN obs AND i <= greatest(t - 1, 0) THEN CASE WHEN i = 1 THEN 'first' WHEN coalesce(text, '') = '' OR n < 300 THEN 'small' WHEN regexp_matches(left(text, 4000), '(^|\\n)\\s*(error|Error|ERROR|ERR_|FAIL|FAILED|Failed|failed|✗|×|not ok|Traceback|panic|Exception|cannot |could not )') THEN 'error' ELSE 'mask' END END AS verdict FROM i),
        s AS (SELECT *, coalesce(verdict = 'mask', false) AND sum(CASE WHEN verdict = 'mask' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) >= 0.05 * sum(n) OVER (PARTITION BY conv_id) AS masked FROM v)
        SELECT conv_id, turn, verdict, masked, CASE WHEN masked THEN length('[condense] old tool output elided (' || (len({split("text")}) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END) || ' lines, ' || n || ' chars) [blob:123456789012]') ELSE n END AS chars FROM s""",
    "context_tokens": "SELECT conv_id, cast(sum(length(text)) AS bigint) AS chars, cast(round(sum(length(text)) / 3.3) AS bigint) AS tokens FROM conversations GROUP BY conv_id",
    "epoch_detect": """WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        r AS (SELECT conv_id, turn, n, s AS peak, 0::bigint AS epoch FROM m WHERE n = 1
          UNION ALL SELECT m.conv_id, m.turn, m.n, CASE WHEN m.s < r.peak * 0.9 AND r.peak - m.s > 200 THEN m.s ELSE greatest(r.peak, m.s) END, r.epoch + CASE WHEN m.s < r.peak * 0.9 AND r.peak - m.s > 200 THEN 1 ELSE 0 END FROM r JOIN m ON m.conv_id = r.conv_id AND m.n = r.n + 1)
        SELECT conv_id, turn, epoch FROM r""",
    "frozen_prefix": """WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN left('the same beginning of every turn''s prefix, whatever follows', cast(turn * 9 + 10 AS bigint)) ELSE left(text, cast(turn % 3 * 40 + 20 AS bigint)) END AS p FROM conversations),
        l AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM m),
        k AS (SELECT *, CASE WHEN b IS NULL OR length(b) = 0 THEN 1.0 ELSE len(list_filter(range(1, least(length(p), length(b)) + 1), lambda i: left(p, i) = left(b, i))) / length(b) END AS r FROM l)
        SELECT conv_id, turn, round(r, 6) AS ratio, CASE WHEN r >= 0.9 THEN 'frozen' WHEN length(p) < length(b) * 0.6 THEN 'truncation' ELSE 'mutation' END AS cause FROM k""",
    "view_toc": f"SELECT doc_id AS seq, left({split('text')}[1], 80) AS line, '[blob:' || left(sha256(text), 12) || ':' || length(text) || ']' AS ref FROM documents ORDER BY doc_id LIMIT 24",
    "usage_stats": f"WITH {_usage} SELECT session, count(*) AS requests, cast(sum(i) AS bigint) AS input_tokens, cast(sum(o) AS bigint) AS output_tokens, cast(sum(cr) AS bigint) AS cache_read, round(sum(cr) / nullif(sum(i), 0), 6) AS cache_ratio, cast(sum(greatest(i - cr, 0)) AS bigint) AS fresh_input FROM u GROUP BY session",
    "usage_cost": f"""WITH {_usage}, p(k, price_id, a, b, c) AS (VALUES (0, 'vendor/model-0', 3.0, 15.0, 0.3), (1, 'other/model-1', 1.0, 2.0, NULL), (2, 'model-2-large', 5.0, 25.0, NULL))
        SELECT 'Vendor/model-' || (user_id % 5) AS model, price_id, round(sum((greatest(i - cr, 0) * a + o * b + cr * coalesce(c, a * 0.1)) / 1e6), 6) AS cost FROM u LEFT JOIN p ON p.k = user_id % 5 GROUP BY 1, 2""",
    "ols_tokens": """WITH d AS (SELECT lang, length(text)::double AS a, len(regexp_extract_all(text, '[éèàüöäß]'))::double AS c, (floor(length(text) / 4) + length(source))::double AS t FROM documents WHERE text IS NOT NULL),
        s AS (SELECT lang, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(c, c) AS cc, covar_pop(a, c) AS ac, covar_pop(a, t) AS t_a, covar_pop(c, t) AS t_c, avg(a) AS ma, avg(c) AS mc, avg(t) AS mt FROM d GROUP BY lang),
        k AS (SELECT *, CASE WHEN cc > 0 THEN (t_a * cc - t_c * ac) / (aa * cc - ac * ac) ELSE t_a / aa END AS b, CASE WHEN cc > 0 THEN (t_c * aa - t_a * ac) / (aa * cc - ac * ac) ELSE 0 END AS g FROM s)
        SELECT lang, n AS samples, round(b, 4) AS slope_ascii, round(g, 3) + 0.0 AS slope_cjk, round(mt - b * ma - g * mc, 2) AS intercept FROM k""",
    "running_mean": """WITH s AS (SELECT user_id, list((value * 4 + 1) / (value + 1) ORDER BY event_id) AS r FROM events WHERE value * 4 + 1 > 0 AND value + 1 > 0 GROUP BY user_id)
      SELECT user_id, len(r) AS samples, round(list_reduce(r, lambda m, x, i: m + (x - m) / least(i, 8)), 6) AS chars_per_token FROM s""",
    "ece_bins": """WITH r AS (SELECT greatest(0.0, least(0.9999, n_chars * 37 % 101 / 100.0))::double AS c, (quality = 1)::int AS hit FROM labels JOIN documents USING (doc_id)), g AS (SELECT cast(floor(c * 10) AS bigint) AS bin, count(*) AS n, avg(c) AS confidence, avg(hit) AS accuracy FROM r GROUP BY 1)
        SELECT b.bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g USING (bin)""",
    "pressure_growth": f"""WITH {_usage}, w AS (SELECT *, i - lag(i) OVER (PARTITION BY session ORDER BY turn) AS rise FROM u),
        g AS (SELECT session, turn, coalesce(avg(rise) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0) AS growth, sum(cr) OVER f / nullif(sum(i) OVER f, 0) AS ratio FROM w WINDOW f AS (PARTITION BY session ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
        s AS (SELECT *, CASE WHEN growth > 4000 THEN 3 WHEN growth > 1500 THEN 1 ELSE 0 END + CASE WHEN ratio < 0.4 THEN 3 WHEN ratio < 0.6 THEN 1 ELSE 0 END + {_pts} AS score FROM g)
        SELECT session, turn, round(growth, 6) AS growth, round(ratio, 6) AS cache_ratio, cast(score AS bigint) AS score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "cache_dips": f"WITH {_usage}, r AS (SELECT *, cr / nullif(i, 0) AS ratio FROM u) SELECT session, turn, coalesce(lag(ratio) OVER (PARTITION BY session ORDER BY turn) - ratio > 0.15, false) AS dip FROM r",
    "budget_info": f"WITH {_usage} SELECT session, turn, 9000 - i AS headroom, round((9000 - i) / 9000, 6) AS pct, i > 9000 AS over, 9000 - i > 0 AND i / 9000 >= 0.8 AS warn FROM u",
    "session_snapshot": f"SELECT user_id, count(*) AS events, {', '.join(f'count(*) FILTER (event_type = {q(k)}) AS n_{k}' for k in KINDS)}, min(ts) AS started, max(ts) AS last_at, arg_max(event_type, ts) AS last_kind FROM events GROUP BY user_id",
    "active_ttl": "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) <= 21600000000, false) AS still FROM events",
    "heartbeat_live": "SELECT user_id, max(ts) >= TIMESTAMP '2024-01-07 18:00:00' AS alive FROM events GROUP BY user_id",
    "recall_followed": "WITH w AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events) SELECT event_id AS seq, coalesce(nx IN ('purchase', 'click'), false) AS followed FROM w WHERE event_type = 'view'",
    "playbook_top": "SELECT user_id AS path, count(*) FILTER (event_type <> 'error') AS helpful, count(*) FILTER (event_type = 'error') AS harmful, max(epoch_us(ts) // 1000) AS last_at FROM events GROUP BY user_id ORDER BY helpful DESC, last_at DESC, path LIMIT 24",
    "ring_buffer": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 7",
    "freshness_replay": f"""WITH {_files}, j AS (SELECT d.*, CASE WHEN s.p IS NULL THEN 'deleted' WHEN s.mtime = d.doc_id AND s.size = d.n_chars THEN 'intact' ELSE 'modified' END AS class FROM d LEFT JOIN snap s USING (p))
        SELECT class, count(DISTINCT p) AS paths, count(*) AS rows, cast(sum(n_chars) AS bigint) AS chars FROM j GROUP BY class""",
    "tool_hits": f"""WITH {_files}, b AS (SELECT p, arg_max(doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END * 1000000000 + doc_id) AS id FROM d GROUP BY p), j AS (SELECT d.doc_id, s.p AS sp, s.mtime = x.doc_id AND s.size = x.n_chars AS same FROM d JOIN b USING (p) JOIN d x ON x.doc_id = b.id LEFT JOIN snap s ON s.p = d.p),
        r AS (SELECT CASE WHEN sp IS NULL THEN 'file deleted' WHEN same THEN 'unchanged' ELSE 'file modified' END AS reason FROM j) SELECT CASE reason WHEN 'unchanged' THEN 'serve' WHEN 'file modified' THEN 'delta' ELSE 'run' END AS decision, reason, count(*) AS calls FROM r GROUP BY reason""",
    "window_serve": f"""WITH {_files}, b AS (SELECT p, max(doc_id) AS id FROM d WHERE doc_id % 2 = 0 GROUP BY p),
        j AS (SELECT d.doc_id AS call_id, b.id, s.mtime = x.doc_id AND s.size = x.n_chars AS same, CASE WHEN {split("x.text")}[-1] = '' THEN {split("x.text")}[:-2] ELSE {split("x.text")} END AS a FROM d LEFT JOIN b USING (p) LEFT JOIN d x ON x.doc_id = b.id LEFT JOIN snap s ON s.p = d.p),
        r AS (SELECT *, CASE WHEN id IS NULL THEN 'no-blob' WHEN NOT coalesce(same, false) THEN 'stale' WHEN len(a) < 2 THEN 'out-of-bounds' END AS reason FROM j)
        SELECT call_id, reason, sha256(CASE WHEN reason IS NULL THEN array_to_string(list_transform(range(2, least(4, len(a) + 1)), lambda i: i || ': ' || CASE WHEN length(regexp_replace(a[i], '\\r$', '')) > 2000 THEN left(regexp_replace(a[i], '\\r$', ''), 2000) || '… [' || (length(regexp_replace(a[i], '\\r$', '')) - 2000) || ' chars truncated]' ELSE regexp_replace(a[i], '\\r$', '') END), chr(10)) END) AS sha FROM r""",
    "side_effects": f"SELECT doc_id, [{', '.join(str(e).lower() for _, e in COMMANDS)}][doc_id % {len(COMMANDS)} + 1] AS effect FROM documents",
    "stack_traces": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {found(split("coalesce(text, '')") + "[-1]", reduce._ERROR_HEAD)} AS open FROM documents),
        f AS (SELECT *, '    at run (src/app.js:1:2)' || chr(10) || '  [... 2 runtime frames collapsed]' || chr(10) || 'end' AS x FROM d),
        o AS (SELECT doc_id, length(t) + 2 * length({q(TRACE)}) + 2 AS before, t || chr(10) || CASE WHEN open THEN '' ELSE 'start' || chr(10) || 'Error: boom' || chr(10) END || x || chr(10) || 'start' || chr(10) || 'Error: boom' || chr(10) || x AS o FROM f)
        SELECT doc_id, cast(2 AS bigint) AS traces, before - length(o) AS saved, sha256(o) AS sha FROM o""",
    "symbol_extract": """WITH s AS (SELECT page_id, replace(regexp_extract(html, '(?s)<script>(.*?)</script>', 1), ';', ';' || chr(10)) AS code FROM pages)
        SELECT page_id, 'function page(' || page_id || ') {' || chr(10) || code || '}' AS definition, 'function page(' || page_id || ') { ... }' || chr(10) || 'const z = 1;' AS skeleton FROM s WHERE length(code) > 0""",
    "price_html_extract": """SELECT page_id, 1::bigint AS row, 'm-' || page_id AS model, (page_id % 10) + 0.5::double AS input_per_m, 7.0::double AS output_per_m FROM pages UNION ALL SELECT page_id, 2, 'm-' || page_id, 2.0, page_id::double FROM pages""",
    "stream_session_counts": f"SELECT user_id, count(*) AS events, {', '.join(f'count(*) FILTER (event_type = {q(k)}) AS n_{k}' for k in KINDS)}, min(epoch_us(ts) // 1000) AS started, max(epoch_us(ts) // 1000) AS last_at FROM events GROUP BY user_id",
}
ORACLE_SQL["rollup_bench"] = CRUSH.split("\nSELECT d.doc_id")[0] + """
SELECT lang, count(*) AS items, cast(sum(length(d.text)) AS bigint) AS before, cast(sum(coalesce(length(j.t), length(d.text))) AS bigint) AS after
FROM documents d LEFT JOIN j USING (doc_id) WHERE d.text IS NOT NULL GROUP BY ROLLUP (lang)"""
