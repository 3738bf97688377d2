"""Facts that a reduced text must still hold: negations, error lines, URLs, versions, hashes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, any_word, col, has_any, let, word

PER_KIND = 40
# Words and formats that count as commitments.
_NEGATIONS = (
    "ne|n|pas|jamais|aucun|aucune|sans|ni|non|not|no|never|without|cannot|can't|don't|doesn't|didn't|isn't|aren't|won't|wouldn't|shouldn't|couldn't"
    "|neither|nor|nunca|jamas|jamás|sin|tampoco|nicht|keine|keiner|keinen|nie|niemals|ohne"
)
NEGATION = word(_NEGATIONS)
_NEGATION = any_word(_NEGATIONS.split("|"))
ERROR_LINE = (
    r"(?:^|\n)([ \t]*(?:✗|×|not ok)[^\n]*|[^\n]*(?:(?<![A-Za-z0-9_])ERROR(?![A-Za-z0-9_])|ERR_|(?<![A-Za-z0-9_])Errno(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])FAIL(?:ED|URE)?(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])panic(?![A-Za-z0-9_])|Traceback \(most recent|Exception(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])fatal(?![A-Za-z0-9_]))[^\n]*)"
)
ATOMS = {
    "url": r"""(?i)(https?://[^\s<>"')\]]+)""",
    "version": r"(?i)((?<![a-z0-9_])v?[0-9]+\.[0-9]+\.[0-9]+(?:[-+][a-z0-9_.-]+)?(?![a-z0-9_])|(?<![a-z0-9_])[a-z][a-z0-9_-]*@[\^~]?[0-9]+(?:\.[0-9]+){1,2}(?![a-z0-9_]))",
    "hash": r"((?<![A-Za-z0-9_])(?:0x[a-f0-9]+|[a-f0-9]{10,64})(?![A-Za-z0-9_]))",
    "path": r"(?i)((?:/[a-z0-9_.@%+-]+){2,}/?|(?<![a-z0-9_])[a-z0-9_.-]+/[a-z0-9_./-]+\.[a-z0-9]{1,6}(?![a-z0-9_]))",
}
KINDS = ["negation", "error", *ATOMS]


#: Without one of these in a text it has no error line.
_ERROR_PARTS = ["ERROR", "ERR_", "Errno", "FAIL", "panic", "Traceback (most recent", "Exception", "fatal", "✗", "×", "not ok"]


def _may_have(text: Column, kind: str) -> Column:
    """Whether a text has what all atoms of a kind have: a test that costs far less than their pattern."""
    if kind == "version":
        return text.rlike(r"[0-9]\.[0-9]") & (text.contains("@") | text.rlike(r"[0-9]\.[0-9]+\.[0-9]"))
    if kind == "hash":
        return text.rlike("[a-f0-9]{10}") | text.contains("0x")
    return text.contains("://" if kind == "url" else "/")


def count_negations(c: ColumnOrName) -> Column:
    return F.regexp_count(F.lower(col(c)), F.lit(_NEGATION)).cast("bigint")


def error_lines(c: ColumnOrName) -> Column:
    none = F.array().cast("array<string>")
    found = F.when(~has_any(col(c), _ERROR_PARTS), none).otherwise(F.transform(F.regexp_extract_all(col(c), F.lit(ERROR_LINE), F.lit(1)), lambda x: F.trim(x)))
    return F.slice(F.filter(found, lambda x: F.length(x) >= 4), 1, PER_KIND)


def atoms(c: ColumnOrName, kind: str) -> Column:
    """Distinct URLs, versions, hashes or paths among the first ``PER_KIND`` that are long enough."""
    least = 8 if kind == "url" else 4
    every = F.when(~_may_have(col(c), kind), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(col(c), F.lit(ATOMS[kind]), F.lit(1)))
    found = F.filter(every, lambda x: F.length(x) >= least)
    return F.array_distinct(F.slice(found, 1, PER_KIND))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def compare(original: ColumnOrName, reduced: ColumnOrName) -> Column:
    """Struct ``total, preserved, missed, by_kind``."""
    both = F.struct(F.coalesce(col(original), F.lit("")).alias("original"), F.coalesce(col(reduced), F.lit("")).alias("reduced"))
    # both once: in the tests of each fact they would be computed anew
    return let(both, lambda x: _compared(x["original"], x["reduced"]))


def _compared(original: Column, reduced: Column) -> Column:
    def lost_of(x: Column, kind: str) -> Column:
        if kind == "error":
            return F.when(F.size(x[kind]) == 0, x[kind]).otherwise(let(_squeezed(reduced), lambda t: F.filter(x[kind], lambda v: ~t.contains(_squeezed(v)))))
        return F.filter(x[kind], lambda v: ~reduced.contains(v))

    def told(lost: Column, kind: str) -> Column:
        return F.transform(lost, lambda v: F.concat(F.lit(f"{kind}: "), F.left(v, F.lit(80)) if kind == "error" else v))

    def report(x: Column) -> Column:
        parts, missed, kept = [x["neg_in"]], [], F.least(x["neg_in"], x["neg_out"])
        note = F.concat(F.lit("negation: "), x["neg_in"].cast("string"), F.lit(" expected, "), x["neg_out"].cast("string"), F.lit(" present"))
        missed.append(F.when(x["neg_out"] < x["neg_in"], F.array(note)).otherwise(F.array().cast("array<string>")))
        for k in ("error", *ATOMS):
            own, lost = x[k], x["lost"][k]
            parts.append(F.size(own).cast("bigint"))
            kept = kept + (F.size(own) - F.size(lost)).cast("bigint")
            missed.append(told(lost, k))
        return F.struct(
            sum(parts[1:], parts[0]).alias("total"), kept.alias("preserved"), F.slice(F.concat(*missed), 1, PER_KIND).alias("missed"),
            F.struct(*(p.alias(k) for k, p in zip(KINDS, parts, strict=True))).alias("by_kind"),
        )

    facts = F.struct(
        count_negations(original).alias("neg_in"), count_negations(reduced).alias("neg_out"),
        error_lines(original).alias("error"), *(atoms(original, k).alias(k) for k in ATOMS),
    )
    losses = lambda x: F.struct(*(lost_of(x, k).alias(k) for k in ("error", *ATOMS)))
    return let(facts, lambda x: let(losses(x), lambda lost: report(F.struct(*(x[k].alias(k) for k in ("neg_in", "neg_out", "error", *ATOMS)), lost.alias("lost")))))
