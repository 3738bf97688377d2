"""Secrets: patterns, counts and replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col, has_any, let, lines
from .text import char_entropy

# Formats of keys, tokens and URLs, in the order in which they are replaced.
PATTERNS = {
    "pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----",
    "conn-url": r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]*:[^\s]+@[^\s]+",
    "aws-secret": r"""(?i)(?<![a-z0-9_])aws[_-]?secret[_-]?access[_-]?key\s*['"]?\s*[:=]\s*['"]?[a-z0-9/+=_-]{32,}['"]?""",
    "aws-access-key": r"A(?:KIA|SIA)[0-9A-Z]{16}",
    "bearer": r"(?i)(?<![a-z0-9_])(?:Bearer|Basic)\s+[a-z0-9._~+/=-]{16,}",
    "jwt": r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9_])",
    "kv": r"""(?i)(?<![a-z0-9_])[a-z0-9_.-]{0,64}?(?:api[_-]?key|secret[_-]?key|secret|token|passwd|password|authorization)\s*['"]?\s*[:=]\s*['"]?[a-z0-9/+=._!@#$%^&*~-]{16,}['"]?""",
    "provider": (
        r"(?<![A-Za-z0-9_])(?:gh[opsur]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}"
        r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]*[A-Za-z0-9]{20,}|gsk_[A-Za-z0-9]{20,}|xai-[A-Za-z0-9]{20,}"
        r"|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{30,}|xox[bpcs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,})(?![A-Za-z0-9_])"
    ),
}
KINDS = [*PATTERNS, "entropy"]
_HINT = r"(?i)(?:key|secret|token|passw|authorization)[a-z0-9_-]*['\"]?\s{0,5}[:=]"
_TOKEN = r"([A-Za-z0-9+/_-]{20,}={0,2})"
_ASSIGNED = r"([A-Za-z0-9_.-]{3,})\s*['\"]?\s*[:=]\s*$"
_ARTICLES = r"(?i)^(the|and|or|for|to|on|in|of|is|are|was|were)$"
BITS = 4.5


# A text without one of these, for the first three of which it is lower-cased, has no secret of the kind.
_NEEDS = {
    "aws-secret": ["aws"], "bearer": ["bearer", "basic"], "kv": ["key", "secret", "token", "passw", "authorization"],
    "pem": ["-----BEGIN "], "conn-url": ["://"], "aws-access-key": ["AKIA", "ASIA"], "jwt": ["eyJ"],
    "provider": ["gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "sk-", "gsk_", "xai-", "hf_", "npm_", "xox", "AIza"],
}
_ANY_CASE = ("aws-secret", "bearer", "kv")


def mark(kind: str) -> str:
    return f"[redacted:{kind}]"


def char_classes(c: Column) -> Column:
    """How many of lower case, upper case, digits and others a token has."""
    return sum((c.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), c.rlike("[a-z]").cast("int"))


def is_random(tok: Column) -> Column:
    """Whether a token looks like a random secret."""
    path = tok.contains("/") & (F.lower(tok) == tok)
    return (F.length(tok) <= 256) & ~tok.rlike("^[0-9a-fA-F]+$") & (char_classes(tok) >= 3) & ~path & (char_entropy(tok) >= BITS)


def _line_pieces(line: Column) -> Column:
    """A line cut in order into random tokens that are assigned or alone (``hit``) and the rest."""
    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(1))

    def step(acc: Column, tok: Column) -> Column:
        rest = acc["rest"]
        p = F.instr(rest, tok)
        before = F.concat(acc["seen"], F.left(rest, p - 1))
        after = F.substr(rest, p + F.length(tok))
        name = F.regexp_extract(F.right(before, F.lit(80)), _ASSIGNED, 1)
        assigned = (name != "") & ~name.rlike(_ARTICLES)
        alone = (F.trim(before) == "") & (F.trim(after) == "")
        # the place is asked before the entropy, and both once
        return let((assigned | alone) & is_random(tok), lambda hit: F.struct(
            F.concat(before, tok).alias("seen"),
            F.concat(acc["out"], F.left(rest, p - 1), F.when(hit, F.lit(mark("entropy"))).otherwise(tok)).alias("out"),
            after.alias("rest"),
            (acc["n"] + hit.cast("int")).alias("n"),
        ))

    start = F.struct(F.lit("").alias("seen"), F.lit("").alias("out"), line.alias("rest"), F.lit(0).alias("n"))
    return F.aggregate(tokens, start, step, lambda a: F.struct(F.concat(a["out"], a["rest"]).alias("line"), a["n"].alias("n")))


def _entropy_pass(text: Column) -> Column:
    whole = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
    return F.when(text.rlike(_TOKEN), _by_lines(text)).otherwise(whole)


def _by_lines(text: Column) -> Column:
    done = F.transform(lines(text), lambda x: F.when(x.rlike(_TOKEN), _line_pieces(x)).otherwise(F.struct(x.alias("line"), F.lit(0).alias("n"))))
    return let(done, lambda d: F.struct(
        F.array_join(F.transform(d, lambda x: x["line"]), "\n").alias("text"), F.aggregate(d, F.lit(0), lambda a, x: a + x["n"]).cast("bigint").alias("n")))


def redact(c: ColumnOrName) -> Column:
    """Struct ``text, counts``: every secret replaced by ``[redacted:kind]``, and how many of each kind.
    Kinds are replaced one after another; random tokens come last and are judged line by line
    from left to right.  A null text stays null."""

    def apply(kinds: list[str], text: Column, counts: list[Column]) -> Column:
        if not kinds:
            return let(_entropy_pass(text), lambda e: F.struct(
                e["text"].alias("text"), F.struct(*(n.alias(k.replace("-", "_")) for k, n in zip(PATTERNS, counts, strict=True)), e["n"].alias("entropy")).alias("counts")))
        kind, pattern = kinds[0], PATTERNS[kinds[0]]
        gate = has_any(F.lower(text) if kind in _ANY_CASE else text, _NEEDS[kind])
        if kind == "kv":
            gate = gate & text.rlike(_HINT)
        same = F.struct(text.alias("t"), F.lit(0).cast("bigint").alias("n"))
        count = F.when(gate, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("bigint")
        replaced = let(count, lambda n: F.when(n > 0, F.struct(F.regexp_replace(text, pattern, mark(kind).replace("$", "\\$")).alias("t"), n.alias("n"))).otherwise(same))
        return let(replaced, lambda s: apply(kinds[1:], s["t"], [*counts, s["n"]]))

    text = col(c)
    return F.when(text.isNotNull(), apply(list(PATTERNS), text, []))


def total(counts: Column) -> Column:
    return sum((counts[k.replace("-", "_")] for k in KINDS[1:]), counts[KINDS[0]])


def has_secrets(c: ColumnOrName) -> Column:
    return let(redact(c), lambda r: total(r["counts"]) > 0)
