"""What a text is: JSON, log, search result, code, diff or prose; binary or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, any_of, any_word, col, count_where, let, lines, word

# What lines of each kind look like.
_FRAME = [r"^at [A-Za-z0-9_$./<>-]+\s*\(.*\)$", r'^File ".*", line [0-9]+', r"^raise [A-Za-z0-9_.]+"]
_LOG_WORDS = "ERROR|FAIL|WARN|INFO|DEBUG|TRACE|PASSED|FAILED|ok"
_LOG = [
    word(_LOG_WORDS),
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}",
    r"^\[[0-9]{2}:[0-9]{2}:[0-9]{2}\]",
    r"^(npm ERR!|Traceback|panic:)",
    *_FRAME,
]
# How a line of code begins, a search result, a patch.
_CODE_START = r"^(import |export |from |require\(|const |let |var |function |class |interface |type |def |fn |func |pub |impl )"
_SEARCH = r"^[^\s:]+:[0-9]+:"
_DIFF = r"^(diff --git|--- a/|@@ -[0-9]+,[0-9]+ \+[0-9]+,[0-9]+ @@)"


# A text without these has no line of the kind.  A line begins behind a newline, in whatever form it is stripped.
_MAY_LOG = r"""(?dm)^[ \t\r]*(?:at |File "|raise |[0-9]{4}-|\[[0-9]{2}:|npm ERR!|Traceback|panic:)"""
_MAY_CODE = r"(?dm)^(?:[ \t]{2}|[ \t\r]*" + _CODE_START[1:] + ")"


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def is_log_line(line: Column) -> Column:
    return any_of(_stripped(line), [any_word(_LOG_WORDS.split("|")), *_LOG[1:]])


def is_code_line(line: Column) -> Column:
    t = _stripped(line)
    looks = t.rlike(_CODE_START) | (t.rlike("[{};]$") & t.rlike("[=()]")) | (line.rlike(r"^[ \t]{2,}") & t.rlike(r"[=;{}()\[\],<>]"))
    return looks & ~any_of(t, _FRAME)


def is_search_line(line: Column) -> Column:
    return line.rlike(_SEARCH)


def line_votes(c: ColumnOrName) -> Column:
    """Lines that are not blank, and how many of them look like log, code or search output.  Lines are only tested
    for what the text can have at all."""
    text = col(c)
    full = F.filter(lines(text), lambda x: _stripped(x) != "")
    may_log = text.rlike(any_word(_LOG_WORDS.split("|"))) | text.rlike(_MAY_LOG)
    may_code = text.rlike("[{};]") | text.rlike(_MAY_CODE)

    def votes(a: Column, may: Column, test) -> Column:
        return F.when(may, count_where(a, test)).otherwise(0).cast("bigint")

    return let(full, lambda a: F.struct(
        F.size(a).cast("bigint").alias("n"), votes(a, may_log, is_log_line).alias("log"),
        votes(a, text.rlike(":[0-9]"), is_search_line).alias("search"), votes(a, may_code, is_code_line).alias("code"),
    ))


def is_json(c: ColumnOrName) -> Column:
    """Whether the text is a JSON object or array."""
    t = _stripped(col(c))
    return F.coalesce(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), F.lit(False))


def detect_type(c: ColumnOrName) -> Column:
    """Struct ``type, confidence``."""
    text = col(c)
    t = _stripped(text)

    def of(kind: str, confidence: Column | float) -> Column:
        return F.struct(F.lit(kind).alias("type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))

    def vote(v: Column) -> Column:
        share = lambda k: v[k] / v["n"]
        return (
            F.when(v["n"] == 0, of("text", 0.5))
            .when(v["log"] * 2 >= v["n"], of("log", F.least(F.lit(1.0), 0.5 + share("log") * 0.5)))
            .when(v["search"] * 10 >= v["n"] * 3, of("search", F.least(F.lit(1.0), 0.4 + share("search") * 0.6)))
            .when(v["code"] * 10 >= v["n"] * 3, of("code", F.least(F.lit(1.0), 0.5 + share("code") * 0.5)))
            .otherwise(of("text", 0.5))
        )

    return (
        F.when(text.isNull() | (t == ""), of("text", 0.5))
        .when(is_json(text), F.when(t.startswith("["), of("json", 0.9)).otherwise(of("json", 0.8)))
        .when(t.rlike(_DIFF), of("diff", 0.85))
        .otherwise(let(line_votes(text), vote))
    )


def route(type_: ColumnOrName) -> Column:
    """The kind of reduction that suits a content type."""
    t = col(type_)
    return F.when(t == "json", "json").when(t == "log", "stacktrace").when(t.isin("search", "diff", "code"), "digest").otherwise("prose")


def is_binary(c: ColumnOrName) -> Column:
    """NUL or many control characters; or, without marks of text, three long lines of base64 only."""
    text = F.coalesce(col(c), F.lit(""))
    sample = F.left(text, F.lit(8192))
    control = F.regexp_count(sample, F.lit("[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    textual = any_of(sample, [r"</?[a-z][\s\S]{0,200}?>", r"https?://\S+", r"(?m)^#+\s", "[\\u00C0-\\u017F]"])
    long_lines = F.filter(lines(text), lambda x: F.length(x) >= 8)
    packed = let(F.filter(long_lines, lambda x: F.trim(x) != ""), lambda a: (F.size(a) >= 3) & F.forall(a, lambda x: F.trim(x).rlike("^[A-Za-z0-9+/=]+$")))
    return (text != "") & (sample.rlike("\\x00") | (control / F.greatest(F.length(sample), F.lit(1)) > 0.1) | (~textual & packed))
