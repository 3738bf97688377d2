"""Reducers: whole texts to shorter ones that keep what matters.

All fail open: where the result would not be shorter the input comes back.  Each returns a struct
with ``text`` and counters, takes one row and needs no shuffle.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import count_by_first, coverage_size, prefix_within
from .base import ColumnOrName, any_of, any_word, col, has_any, joined, let, lines, word
from .detect import detect_type
from .language import NEGATIONS, PROTECTED, STOPWORDS, detect_language, is_protected, words_of
from .text import bigrams, estimate_tokens, fold_ascii


# What makes a segment salient, and what is always kept.
TROUBLE = "(?i)" + word("error|exception|failed|fail|warning|traceback|assert|todo|fixme")
NUMBER, CAPITALS, DOTTED = word("[0-9]+"), word("[A-Z]{2,}"), r"[A-Za-z0-9_.-]+\.[A-Za-z0-9_-]+"
FORCED = [
    "(?i)error|fail|exception|traceback|✗|×|not ok",
    r"(?i)(?<![a-z0-9_])(https?://|www\.)",
    "(?i)" + word(r"v?[0-9]+\.[0-9]+(\.[0-9]+)*"),
    word("[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    word("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"),
    r"(?i)(?<![a-z0-9_])[0-9]+([.,][0-9]+)?\s?(%|€|\$|£|USD|EUR|KB|MB|GB|TB|ms|µs|ns)",
    "(?i)" + word("[a-f0-9]{7,40}"),
    "(?i)" + word("ne|pas|jamais|rien|aucun|aucune|ni|sans|not|no|never|none|nunca|nada|nicht|nie|kein|keine|niemals"),
]


def segments(c: ColumnOrName) -> Column:
    """Sentences and lines of at least 12 characters, cut at 500."""
    parts = F.transform(F.split(col(c), r"(?=[ \t\r\n])(?:(?<=[.!?])[ \t\r\n]+|\n+)"), lambda s: F.btrim(s, F.lit(" \t\r\n")))
    return F.transform(F.filter(parts, lambda s: F.length(s) >= 12), lambda s: F.when(F.length(s) > 500, F.concat(F.left(s, F.lit(500)), F.lit("…"))).otherwise(s))


def salience(s: Column) -> Column:
    """Score in halves of a point, as a whole number."""
    return F.when(s.rlike(TROUBLE), 3).otherwise(0) + sum((s.rlike(p).cast("int") for p in (CAPITALS, DOTTED)), s.rlike(NUMBER).cast("int"))


# Without one of these, in lower case, nothing in a text is in trouble, or a URL.
_TROUBLE_PARTS, _BOTH_PARTS = ["warning", "assert", "todo", "fixme"], ["error", "exception", "fail", "traceback"]
_FORCED_PARTS, _URL_PARTS = ["✗", "×", "not ok"], ["://", "www."]
# The same tests as ``NUMBER``, ``CAPITALS``, ``DOTTED`` and the last two of ``FORCED``, beginning with what is rare.
_NUMBER, _CAPITALS = r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]*(?![A-Za-z0-9_])", r"[A-Z]{2}(?<![A-Za-z0-9_][A-Z]{2})[A-Z]*(?![A-Za-z0-9_])"
_DOTTED = r"\.(?<=[A-Za-z0-9_.-]\.)[A-Za-z0-9_-]"
_HASH = "(?i)[a-f0-9](?<![a-z0-9_][a-f0-9])[a-f0-9]{6,39}(?![a-z0-9_])"
_NOT = "(?i)" + any_word("ne pas jamais rien aucun aucune ni sans not no never none nunca nada nicht nie kein keine niemals".split())


def _gates(text: Column) -> Column:
    """Which tests a part of a text can meet at all: most texts have nothing for most of them."""

    def of(t: Column) -> Column:
        return let(has_any(t, _BOTH_PARTS), lambda both: F.struct(
            (both | has_any(t, _TROUBLE_PARTS)).alias("trouble"), (both | has_any(t, _FORCED_PARTS)).alias("forced"), has_any(t, _URL_PARTS).alias("url"),
            t.rlike("[0-9]").alias("digit"), t.rlike("[a-f0-9]{7}").alias("hash"), text.rlike("[A-Z]{2}").alias("capitals"), text.rlike(r"\.[A-Za-z0-9_-]").alias("dotted")))

    return let(F.lower(text), of)


def _score(s: Column, g: Column) -> Column:
    """:func:`salience` of a part of a text with its :func:`_gates`."""
    found = [(g["capitals"], _CAPITALS), (g["dotted"], _DOTTED), (g["digit"], _NUMBER)]
    return F.when(g["trouble"] & s.rlike(TROUBLE), 3).otherwise(0) + sum(((gate & s.rlike(p)).cast("int") for gate, p in found[1:]), (found[0][0] & s.rlike(found[0][1])).cast("int"))


def _is_forced(s: Column, g: Column) -> Column:
    """Whether one of ``FORCED`` is found."""
    return s.rlike(_NOT) | (g["forced"] & s.rlike(FORCED[0])) | (g["digit"] & s.rlike("[0-9]") & any_of(s, FORCED[2:6])) | (g["hash"] & s.rlike(_HASH)) | (g["url"] & s.rlike(FORCED[1]))


def crush_text(c: ColumnOrName, least_chars: int = 2000, ratio: float = 0.5) -> Column:
    """The most salient segments up to a share of the text, with all that hold errors, figures or
    negations, in their order.  Struct ``text, segments_before, segments_after, was_crushed``."""
    text = col(c)

    def out(t: Column, before: Column | int, after: Column | int, done: bool) -> Column:
        n = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
        return F.struct(t.alias("text"), n(before).alias("segments_before"), n(after).alias("segments_after"), F.lit(done).alias("was_crushed"))

    def crush(a: Column) -> Column:
        return F.when(F.size(a) <= 8, out(text, 0, 0, False)).otherwise(let(_gates(text), lambda g: judged(a, g)))

    def judged(a: Column, g: Column) -> Column:
        n = F.size(a)
        scored = F.array_sort(F.transform(a, lambda s, i: F.struct(
            (-_score(s, g) - F.when((i < 2) | (i >= n - 2), 2).otherwise(0)).alias("s"), i.alias("i"), F.length(s).alias("len"))))

        def chosen(r: Column) -> Column:
            budget = F.ceil(F.length(text) * ratio)
            return let(prefix_within(F.transform(r, lambda x: x["len"]), budget), lambda k: kept_with(r, k))

        def kept_with(r: Column, k: Column) -> Column:
            # what the budget has taken needs no other reason to stay
            forced = F.filter(F.slice(r, k + 1, n), lambda x: _is_forced(F.element_at(a, x["i"] + 1), g))
            places = F.array_sort(F.transform(F.concat(F.slice(r, 1, k), forced), lambda x: x["i"]))
            kept = F.transform(places, lambda i: F.element_at(a, i + 1))
            return let(kept, lambda x: let(joined(x), lambda t: F.when(F.length(t) < F.length(text), out(t, n, F.size(x), True)).otherwise(out(text, 0, 0, False))))

        return let(scored, chosen)

    return F.when(text.isNull() | (F.length(text) < least_chars), out(text, 0, 0, False)).otherwise(let(segments(text), crush))


# Lines of a log that stay, and the figures of a line that become ``#``.
KEPT_LOG_LINE = r"(?i)error|fail|✗|×|not ok|warning|warn:|panic|exception|undefined|cannot|expected|assert|-->|(^|[^a-z0-9_])(at|in)([^a-z0-9_]|$)"
HAS_FIGURE = [word(r"[0-9]+(\.[0-9]+)*"), "(?i)" + word("[0-9a-f]{6,}"), word(r"v?[0-9]+\.[0-9]+(\.[0-9]+)?([-+][A-Za-z0-9_.]+)?")]


FIGURES = [r"v?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][A-Za-z0-9_.]+)?", r"(?<![A-Za-z])[0-9]+(?:\.[0-9]+)*", r"(?<![A-Za-z])[0-9a-fA-F]{6,}"]


def log_template(line: Column) -> Column:
    """A line with ``#`` for versions, numbers and hashes."""
    for figure in FIGURES:
        line = F.regexp_replace(line, figure, "#")
    return line


def is_template_line(line: Column) -> Column:
    return ~line.rlike(KEPT_LOG_LINE) & (F.length(F.trim(line)) >= 8) & any_of(line, HAS_FIGURE)


def collapse_log(c: ColumnOrName, least_lines: int = 8) -> Column:
    """Lines that differ only in figures as one template with its count, behind all others.  Struct
    ``text, was_collapsed, templates``."""
    text = col(c)

    def collapse(a: Column) -> Column:
        own = F.transform(a, lambda x: let(F.regexp_replace(x, r"[ \t\r]+$", ""), lambda y: F.struct(y.alias("x"), F.when(is_template_line(y), log_template(y)).alias("key"))))

        def build(o: Column) -> Column:
            rest = F.transform(F.filter(o, lambda r: r["key"].isNull()), lambda r: r["x"])
            groups = count_by_first(F.transform(F.filter(o, lambda r: r["key"].isNotNull()), lambda r: r["key"]))

            def done(g: Column) -> Column:
                shown = F.transform(g, lambda r: F.when(r["n"] > 1, F.concat(r["key"], F.lit(" (×"), r["n"].cast("string"), F.lit(")"))).otherwise(r["key"]))
                t = joined(F.concat(rest, shown))
                return F.when(F.size(g) == 0, same(a)).otherwise(let(t, lambda t: F.struct(
                    F.when(F.length(t) < F.length(text), t).otherwise(text).alias("text"), (F.length(t) < F.length(text)).alias("was_collapsed"), F.size(g).cast("bigint").alias("templates"))))

            return let(groups, done)

        return F.when(F.size(a) < least_lines, same(a)).otherwise(let(own, build))

    def same(_: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("was_collapsed"), F.lit(0).cast("bigint").alias("templates"))

    return let(lines(text), collapse)


# Lines of stack traces, frames of runtimes, heads of traces.
_FRAMES = [
    r'^File ".*", line \d+', r"^at [A-Za-z0-9_$./<>-]+ ?\(.*\)$", r"^at [A-Za-z0-9_$./<>-]+$", r"^at .*:\d+(?::\d+)?$",
    r"^[A-Za-z0-9_./]+\(\)$", r"^/?[A-Za-z0-9_./-]+:\d+\s+\+0x[0-9a-f]+$", r"^in .+:\d+$",
]
_RUNTIME = [
    r"node_modules/", r"[/\\]dist[/\\]", r"[/\\]build[/\\]", r"(?<![A-Za-z0-9_])(?:core|lib|rt|runtime)/(?:python|go|java|js)(?![A-Za-z0-9_])",
    r"^at (?:process|Module|Function|Object)\.", r'^File "<(?:frozen|stdin|string)[^"]*"', r"java\.base/", r"jdk\.internal\.", r"\(Native Method\)", r"^runtime\.(?:main\(\)|proc|panic)", r"^at jdk\.",
]
_ERROR_HEAD = "(?i)error|exception|traceback|panic|failed|✗|×|not ok|fatal"


def is_frame(line: Column) -> Column:
    t = F.trim(line)
    call = t.rlike(r"^[A-Za-z0-9_]+\.[A-Za-z0-9_]+\(.*\)$") & t.rlike(r":\d+")
    return any_of(t, _FRAMES) | call


def compress_traces(c: ColumnOrName, most_traces: int = 3, most_frames: int = 20) -> Column:
    """Stack traces with their first application frames; runtime frames are counted.  Struct ``text,
    was_compressed, traces``."""
    text = col(c)

    def work(a: Column) -> Column:
        n = F.size(a)
        frames = F.transform(a, lambda x: is_frame(x))

        def with_frames(f: Column) -> Column:
            first = lambda i: F.when(F.try_element_at(f, i + 2), i + 1).when(F.try_element_at(f, i + 3), i + 2).when(F.try_element_at(f, i + 4), i + 3)
            heads = F.filter(F.transform(a, lambda x, i: F.when(x.rlike(_ERROR_HEAD) & first(i).isNotNull(), F.struct(i.alias("i"), first(i).alias("s")))), lambda h: h.isNotNull())
            other = F.filter(F.transform(f, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
            empty = F.array().cast("array<struct<i:int,s:int,e:int>>")

            def step(m: Column, h: Column) -> Column:
                free = F.coalesce(F.try_element_at(m, F.lit(-1))["e"], F.lit(0)) <= h["i"]
                end = F.coalesce(F.array_min(F.filter(other, lambda x: x >= h["s"])), n)
                return F.when(free & (F.size(m) < most_traces), F.concat(m, F.array(F.struct(h["i"].alias("i"), h["s"].alias("s"), end.alias("e"))))).otherwise(m)

            def render(marks: Column) -> Column:
                def add(s: Column, m: Column) -> Column:
                    own = F.slice(a, m["s"] + 1, m["e"] - m["s"])
                    app = F.filter(own, lambda x: ~any_of(F.trim(x), _RUNTIME))
                    runtime, more = F.size(own) - F.size(app), F.size(app) - most_frames
                    note = lambda k, what: F.when(k > 0, F.array(F.concat(F.lit("  [... "), k.cast("string"), F.lit(what)))).otherwise(F.array().cast("array<string>"))
                    return F.struct(
                        F.concat(s["out"], F.slice(a, s["at"] + 1, m["i"] + 1 - s["at"]), F.slice(app, 1, most_frames), note(runtime, " runtime frames collapsed]"), note(more, " more frames]")).alias("out"),
                        m["e"].alias("at"),
                    )

                whole = F.aggregate(marks, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), add, lambda s: F.concat(s["out"], F.slice(a, s["at"] + 1, F.greatest(n - s["at"], F.lit(0)))))
                return let(joined(whole), lambda t: F.struct(t.alias("text"), (t != text).alias("was_compressed"), F.when(t != text, F.size(marks)).otherwise(0).cast("bigint").alias("traces")))

            return let(F.aggregate(heads, empty, step), render)

        return let(frames, with_frames)

    return let(lines(text), work)


#: Trimmed off words before they are looked up: ASCII and typographic characters that are no letters.
NO_LETTERS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalpha()) + "…–—«»“”‘’„¿¡·•€£°§"
# Fixed value: words that begin a line of code.
_CODE_WORDS = "export|import|function|const|let|var|async|await|return|if|else|for|while|class|interface|type|enum|def|fn|func|pub|impl|use|package|require|from"


def is_code_line(line: Column) -> Column:
    t = F.trim(line)
    return (t != "") & (
        (line.rlike(r"^[ \t]{2,}") & t.rlike(r"[=;{}()\[\],<>]")) | t.rlike(r"[;{}\[\]()<>]$") | t.rlike(f"^(?:{_CODE_WORDS})(?![A-Za-z0-9_])") | t.rlike("=>|===|!==")
    )


def compress_prose(c: ColumnOrName, least_chars: int = 500, ratio: float = 0.65, languages: dict[str, str] | None = None) -> Column:
    """Prose without the stopwords of its language, white space and all else unchanged.

    The first and last three words of a line, negations, protected and quoted words stay, and so do
    code lines.  If less than ``ratio`` of the words were left, the longest come back.  Struct
    ``text, was_compressed, lang, words, dropped, restored``; at least a tenth must be saved.
    """
    text, lists = col(c), languages or STOPWORDS
    # a word that folds to a stopword looks like one: where none of them looks protected, words need no test
    looks_protected = any(re.search(p, w) for w in words_of(lists) for p in PROTECTED)

    def none(lang: Column) -> Column:
        z = F.lit(0).cast("bigint")
        return F.struct(text.alias("text"), F.lit(False).alias("was_compressed"), lang.alias("lang"), z.alias("words"), z.alias("dropped"), z.alias("restored"))

    def is_stop(w: Column, lang: Column) -> Column:
        out = w.isin(*words_of(lists)) & ~lang.isin(*lists)
        for name in lists:
            out = out | ((lang == name) & w.isin(*words_of(lists, name)))
        return out

    def tokens(line: Column, lang: Column) -> Column:
        """Struct of a line: its ``pieces``, for each its length if it is dropped (else null) in ``sizes``, and how
        many ``words`` it has."""
        cut = lambda x: F.regexp_extract_all(x, F.lit(r"([ \t\r\f]+|[^ \t\r\f]+)"), F.lit(1))
        # folding leaves white space alone; all that words need of their line is computed once
        lead_ = line.rlike(r"^[ \t\r\f]").cast("int")
        fold = lambda x: fold_ascii(F.lower(x))
        # a word of nothing but accents is gone when it is folded: then the pieces of the folded line are fewer
        aligned = lambda x: F.when(F.size(x["f"]) == F.size(x["p"]), x["f"]).otherwise(F.transform(x["p"], fold))
        both = let(F.struct(cut(line).alias("p"), cut(fold(line)).alias("f")), lambda x: F.struct(x["p"].alias("p"), aligned(x).alias("f"), lead_.alias("lead")))

        def mark(x: Column) -> Column:
            return let(F.shiftright(F.size(x["p"]) + 1 - x["lead"], 1), lambda words: marked(x, words))

        def marked(x: Column, words: Column) -> Column:
            lead = x["lead"]

            def stop(i: Column, w: Column) -> Column:
                folded = F.btrim(F.element_at(x["f"], i + 1), F.lit(NO_LETTERS))
                fine = lambda f: is_stop(f, lang) & ~f.isin(*NEGATIONS)
                if not looks_protected:
                    return let(folded, fine)
                return let(folded, lambda f: fine(f) & ~is_protected(F.btrim(F.lower(w), F.lit(NO_LETTERS))))

            def one(w: Column, i: Column) -> Column:
                at = F.shiftright(i - lead + 1, 1)
                # the cheap tests come first and end the evaluation for most words
                drop = ((i + lead) % 2 == 0) & (at >= 3) & (at < words - 3) & stop(i, w) & ~w.rlike("^[\"'`]|[\"'`]$")
                return F.when(drop, F.length(w))

            return F.struct(x["p"].alias("pieces"), F.transform(x["p"], one).alias("sizes"), words.cast("bigint").alias("words"))

        whole = F.struct(F.array(line).alias("pieces"), F.array(F.lit(None).cast("int")).alias("sizes"), F.lit(1).cast("bigint").alias("words"))
        return F.when(is_code_line(line), whole).otherwise(let(both, mark))

    def compress(lang: Column) -> Column:
        def restore(m: Column) -> Column:
            # pieces of all lines in one row, newlines among them: then length and place make one number, however long a
            # word and however many the lines
            row = lambda of, newline: F.flatten(F.transform(m, lambda x, i: F.when(i > 0, F.concat(F.array(newline), x[of])).otherwise(x[of])))
            # the longest come back first, then the first
            ranks = F.transform(row("sizes", F.lit(None).cast("int")), lambda n, i: F.lit(-(1 << 31)).cast("bigint") * n + i)
            total = F.aggregate(m, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])

            def choose(x: Column, d: Column) -> Column:
                # in decimals: a share of 0.35 of 180 words is 63, by doubles it is less
                need = F.greatest(F.lit(0), F.size(d) - F.floor(x["total"] * F.lit(1 - Decimal(str(ratio)))).cast("int"))
                last = let(need, lambda k: F.struct(k.alias("need"), F.coalesce(F.try_element_at(d, F.nullif(k, F.lit(0))), F.lit(-(1 << 63))).alias("rank")))
                return let(last, lambda back: render(x, d, back))

            def render(x: Column, d: Column, back: Column) -> Column:
                out = F.array_join(F.filter(x["pieces"], lambda w, i: F.coalesce(F.element_at(x["ranks"], i + 1) <= back["rank"], F.lit(True))), "")
                return let(out, lambda t: F.when(F.length(t).cast("bigint") * 10 <= F.length(text).cast("bigint") * 9, F.struct(
                    t.alias("text"), F.lit(True).alias("was_compressed"), lang.alias("lang"), x["total"].alias("words"),
                    F.size(d).cast("bigint").alias("dropped"), back["need"].cast("bigint").alias("restored"))).otherwise(none(lang)))

            parts = F.struct(row("pieces", F.lit("\n")).alias("pieces"), ranks.alias("ranks"), total.alias("total"))
            return let(parts, lambda x: let(F.array_sort(F.filter(x["ranks"], lambda k: k.isNotNull())), lambda d: choose(x, d)))

        return let(F.transform(lines(text), lambda x: tokens(x, lang)), restore)

    return F.when(text.isNull() | (F.length(text) < least_chars), none(F.lit("unknown"))).otherwise(let(detect_language(text, languages=lists), compress))


# -- JSON arrays -----------------------------------------------------------------------------

ROWS = "array<map<string,variant>>"


def json_rows(c: ColumnOrName) -> Column:
    """The rows of a JSON array of objects; null for all else."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^\[\s*\{") & F.try_parse_json(t).isNotNull(), F.from_json(t, ROWS))


def _kind(v: Column) -> Column:
    """``null, bool, int, num, str, array`` or ``object``."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "str").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
        .when(s.isin("BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "int").otherwise("num")
    )


def _text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def column_type(v: Column) -> Column:
    """Type of a cell, strings by their form."""
    k, s = _kind(v), _text_of(v)
    form = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").when(s.rlike(r"^-?\d+(\.\d+)?$"), "num").when(s.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid").otherwise("str")
    return F.when(k == "str", form).when(k == "null", "").otherwise(k)


def _keys(rows: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.map_keys(r))))


def _sample(rows: Column, key: Column) -> Column:
    """The first value of a key that is not null."""
    vals = F.filter(F.transform(rows, lambda r: F.try_element_at(r, key)), lambda v: v.isNotNull() & ~F.is_variant_null(v))
    return F.try_element_at(vals, F.lit(1))


def compact_table(c: ColumnOrName, most_rows: int = 500, most_columns: int = 24, cell_chars: int = 80) -> Column:
    """A JSON array of rows with the same scalar columns as comma-separated lines under a header.
    Struct ``text, was_compacted, rows, cols``."""
    text = col(c)
    none = F.struct(text.alias("text"), F.lit(False).alias("was_compacted"), F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("cols"))

    def cell(v: Column) -> Column:
        s = F.trim(F.regexp_replace(_text_of(v), "[\n\r\t,]", " "))
        return F.coalesce(F.when(_kind(v) == "null", "").when(F.length(s) > cell_chars, F.concat(F.left(s, F.lit(cell_chars - 1)), F.lit("…"))).otherwise(s), F.lit(""))

    def table(rows: Column) -> Column:
        def build(keys: Column) -> Column:
            uniform = F.forall(rows, lambda r: (F.size(r) == F.size(keys)) & F.forall(F.map_values(r), lambda v: ~_kind(v).isin("array", "object")))
            ok = (F.size(rows) <= most_rows) & (F.size(keys) >= 1) & (F.size(keys) <= most_columns) & uniform
            head = F.concat(F.lit("[N="), F.size(rows).cast("string"), F.lit("]{"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(":"), F.coalesce(column_type(_sample(rows, k)), F.lit("")))), ","), F.lit("}"))
            body = F.transform(rows, lambda r: F.array_join(F.transform(keys, lambda k: cell(F.try_element_at(r, k))), ","))
            return F.when(ok, let(joined(F.concat(F.array(head), body)), lambda t: F.when(F.length(t) < F.length(text), F.struct(
                t.alias("text"), F.lit(True).alias("was_compacted"), F.size(rows).cast("bigint").alias("rows"), F.size(keys).cast("bigint").alias("cols"))))).otherwise(none)

        return F.coalesce(let(_keys(rows), build), none)

    return F.coalesce(F.when(F.size(rows := json_rows(text)) > 0, let(rows, table)), none)


def anchors(question: ColumnOrName) -> Column:
    """What a question names: UUIDs, mail addresses, quoted words, long numbers, numbered names, hosts."""
    q = F.coalesce(col(question), F.lit(""))
    uuid = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    found = lambda p: F.regexp_extract_all(q, F.lit(p), F.lit(1))
    uuids = F.transform(found(uuid), lambda x: F.lower(x))
    numbers = F.filter(found(r"(?<![A-Za-z0-9_])(\d{4,})(?![A-Za-z0-9_])"), lambda n: ~F.exists(uuids, lambda u: u.contains(n)))
    names = found(r"(?i)(?<![a-z0-9_])([a-z][a-z0-9]*[-_][a-z0-9]+[-_]\d+|[a-z][a-z0-9]*[-_]\d+)(?![a-z0-9_])")
    hosts = found(r"(?i)(?<![a-z0-9_])([a-z0-9_-]+\.(?:com|io|dev|org|net|app|ai))(?![a-z0-9_])")
    every = F.concat(uuids, found(r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)"), found("[\"'`]([^\"'`]{2,40})[\"'`]"), numbers, names, hosts)
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2))


def crush_json(c: ColumnOrName, question: ColumnOrName | None = None, least_rows: int = 5, least_tokens: int = 200, most_rows: int = 15,
               head: float = 0.3, tail: float = 0.15) -> Column:
    """The telling rows of a JSON array of objects under a line with its size and columns.

    First and last rows, rows that match the question or report errors stay; rows with a value in a
    mostly unique column come next, then any, as long as they add new pairs of words.  Struct
    ``text, was_crushed, rows_before, rows_after``.
    """
    text = col(c)
    asked = anchors(question) if question is not None else F.array().cast("array<string>")
    none = F.struct(text.alias("text"), F.lit(False).alias("was_crushed"), F.lit(0).cast("bigint").alias("rows_before"), F.lit(0).cast("bigint").alias("rows_after"))

    def crush(rows: Column, wanted: Column) -> Column:
        n = F.size(rows)
        shown = F.transform(rows, lambda r: F.to_json(r))

        def pick(keys: Column, js: Column) -> Column:
            spread = F.transform(keys, lambda k: F.struct(k.alias("k"), F.size(F.array_distinct(F.transform(rows, lambda r: F.coalesce(F.to_json(F.try_element_at(r, k)), F.lit("null"))))).alias("u")))

            def choose(cols: Column) -> Column:
                telling = F.transform(F.filter(cols, lambda x: (x["u"] > 1) & (x["u"] > 0.7 * n)), lambda x: x["k"])
                edge = lambda i: (i < F.greatest(F.lit(1), F.floor(n * head))) | (i >= n - F.greatest(F.lit(1), F.floor(n * tail)))
                full = lambda v: v.isNotNull() & ~F.is_variant_null(v) & (F.coalesce(_text_of(v), F.lit("x")) != "")
                # classes: 0 always, 1 telling, 2 filler
                classes = F.transform(rows, lambda r, i: F.struct(
                    F.when(edge(i) | F.element_at(js, i + 1).rlike(FORCED[0]) | F.exists(wanted, lambda a: F.lower(F.element_at(js, i + 1)).contains(a)), 0)
                    .when(F.exists(telling, lambda k: full(F.try_element_at(r, k))), 1).otherwise(2).alias("c"), i.alias("i")))

                def fill(cl: Column) -> Column:
                    sure = F.filter(cl, lambda x: x["c"] == 0)
                    rest = F.filter(cl, lambda x: x["c"] > 0)
                    room = F.greatest(F.lit(0), F.lit(most_rows) - F.size(sure))
                    size = coverage_size(F.transform(rest, lambda x: F.element_at(js, x["i"] + 1)), bigrams, F.lit(0), room)
                    more = F.slice(F.array_sort(rest), 1, F.greatest(F.lit(0), F.least(room, size)))
                    places = F.array_sort(F.transform(F.concat(sure, more), lambda x: x["i"]))
                    kinds = F.transform(cols, lambda x: F.concat(x["k"], F.lit(":"), F.when(x["u"] == 1, "const").otherwise(F.coalesce(_json_type(_sample(rows, x["k"])), F.lit("undefined")))))
                    top = F.concat(F.lit("[N="), n.cast("string"), F.lit("]{"), F.array_join(kinds, ","), F.lit("}"))
                    return let(places, lambda p: let(joined(F.concat(F.array(top), F.transform(p, lambda i: F.element_at(js, i + 1)))), lambda t: F.when(
                        estimate_tokens(t) < estimate_tokens(text), F.struct(t.alias("text"), F.lit(True).alias("was_crushed"), n.cast("bigint").alias("rows_before"), F.size(p).cast("bigint").alias("rows_after")))))

                return let(classes, fill)

            return let(spread, choose)

        return F.when(n >= least_rows, let(_keys(rows), lambda k: let(shown, lambda js: pick(k, js))))

    rows = json_rows(text)
    return F.coalesce(F.when(estimate_tokens(text) >= least_tokens, let(rows, lambda r: let(asked, lambda a: F.when(r.isNotNull(), crush(r, a))))), none)


def _json_type(v: Column) -> Column:
    k = _kind(v)
    return F.when(k.isin("int", "num"), "number").when(k == "bool", "boolean").when(k == "str", "string").otherwise(k)


def smart_compress(c: ColumnOrName) -> Column:
    """The reducer that suits a text: tables and JSON rows, stack traces and logs, or salient prose.
    Struct ``text, strategy``; a text that nothing shortens comes back with ``none``."""
    text = col(c)

    def first(*options: tuple[str, Column]) -> Column:
        # each is computed once, and only where those before it do not shorten the text
        own = [let(t, lambda x: F.when(F.length(x) < F.length(text), F.struct(x.alias("text"), F.lit(name).alias("strategy")))) for name, t in options]
        return F.coalesce(*own, F.struct(text.alias("text"), F.lit("none").alias("strategy")))

    def by(kind: Column) -> Column:
        return (
            F.when(kind == "json", first(("table", compact_table(text)["text"]), ("json", crush_json(text)["text"])))
            .when(kind == "log", first(("stacktrace", compress_traces(text)["text"]), ("log", collapse_log(text)["text"])))
            .when(kind == "text", first(("salient", crush_text(text)["text"])))
            .otherwise(F.struct(text.alias("text"), F.lit("none").alias("strategy")))
        )

    return let(detect_type(text)["type"], by)
