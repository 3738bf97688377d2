"""Folding, tokens, shingles, lines and other scalar text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col, joined, let, lines, text_lines

#: Longest line and output of a numbered window.
LINE_CHARS, OUTPUT_CHARS = 2000, 128 * 1024


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their bases, from their canonical decompositions."""
    pairs = []
    for cp in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(cp), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold_ascii(c: ColumnOrName) -> Column:
    """Without accents; ligatures and sharp s spelled out."""

    def fold(x: Column) -> Column:
        plain = F.translate(F.regexp_replace(x, "[\\u0300-\\u036f]", ""), *_accents())
        for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
            plain = F.replace(plain, F.lit(a), F.lit(b))
        return plain

    return let(col(c), lambda x: F.when(is_ascii(x), x).otherwise(fold(x)))


def path_tokens(c: ColumnOrName) -> Column:
    """Folded words between white space."""
    return F.filter(F.split(fold_ascii(F.lower(col(c))), r"\s+"), lambda a: a != "")


def identifier_tokens(c: ColumnOrName) -> Column:
    """Distinct folded words and their parts of three or more characters between ``_ . / \\ -``."""

    def tokens(t: Column) -> Column:
        # both cuts are made of the whole text: a part is never longer than its word
        words, parts = F.split(t, r"\s+"), F.array_distinct(F.split(t, r"[ \t\n\x0B\f\r_./\\-]+"))
        return F.array_remove(F.array_distinct(F.concat(words, F.filter(parts, lambda p: F.length(p) >= 3))), "")

    return let(fold_ascii(F.lower(col(c))), tokens)


def bigrams(c: ColumnOrName) -> Column:
    """Distinct pairs of neighbouring words of two or more ASCII characters; a single word stands alone."""
    words = F.filter(F.split(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)

    def pairs(w: Column) -> Column:
        n = F.size(w)
        two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.try_element_at(w, i + 1)))
        return F.when(n >= 2, F.array_distinct(two)).otherwise(w)

    return let(words, pairs)


def count_cjk(c: ColumnOrName) -> Column:
    return F.regexp_count(col(c), F.lit("[\\u3040-\\u30FF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF]"))


def estimate_tokens(c: ColumnOrName, chars_per_token: float | Column = 3.3) -> Column:
    """Characters of other scripts by their mean length, each CJK character as a token."""
    cjk = count_cjk(c)
    per = F.greatest(F.lit(1.0), chars_per_token if isinstance(chars_per_token, Column) else F.lit(float(chars_per_token)))
    return F.coalesce(F.ceil((F.length(col(c)) - cjk) / per + cjk), F.lit(0)).cast("bigint")


def char_entropy(c: ColumnOrName) -> Column:
    """Shannon entropy of the characters in bits."""
    text = col(c)

    def bits(runs: Column) -> Column:
        n = F.length(text)
        # x log2 x of each distinct character's count, in the order of the characters
        total = F.aggregate(F.transform(runs, lambda r: F.length(r)), F.lit(0.0).cast("double"), lambda s, k: s + k * F.log2(k))
        return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)

    # sorted and joined, equal characters are runs, which a pattern cuts: nothing is evaluated for each character
    in_order = F.array_join(F.array_sort(F.split(text, "")), "")
    return let(F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*"), F.lit(0)), bits)


def blob_ref(hash_: ColumnOrName, content: ColumnOrName, prefix: int = 12) -> Column:
    return F.concat(F.lit("[blob:"), F.left(col(hash_), F.lit(prefix)), F.lit(":"), F.length(col(content)).cast("string"), F.lit("]"))


def content_hash(c: ColumnOrName) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def call_key(*parts: ColumnOrName) -> Column:
    """A 64-bit key of a call that has no content hash."""
    return F.xxhash64(*(col(p) for p in parts))


def count_lines(c: ColumnOrName) -> Column:
    return F.size(text_lines(c))


def strip_ansi(c: ColumnOrName) -> Column:
    """Without terminal colour codes and titles."""
    plain = F.regexp_replace(col(c), "\\u001B\\[[0-9;?]*[A-Za-z]", "")
    return F.regexp_replace(plain, "\\u001B\\][^\\u0007\\u001B]*(\\u0007|\\u001B\\\\)", "")


def strip_line_numbers(c: ColumnOrName) -> Column:
    """Drop ``N: `` before lines if at least half of the lines that are not blank have it."""
    mark = r"^\s*\d+: "

    def strip(a: Column) -> Column:
        own = F.size(F.filter(a, lambda x: x.rlike(mark)))
        full = F.size(F.filter(a, lambda x: F.trim(x) != ""))
        return F.when((full > 0) & (own * 2 >= full), joined(F.transform(a, lambda x: F.regexp_replace(x, mark, "")))).otherwise(joined(a))

    return let(lines(c), strip)


def line_window(c: ColumnOrName, offset: ColumnOrName, limit: ColumnOrName) -> Column:
    """Lines ``offset`` to ``offset + limit - 1`` with their numbers; null out of bounds.  Long lines
    and outputs are cut with a note."""
    offset, limit = col(offset), col(limit)

    def numbered(a: Column) -> Column:
        own = F.slice(a, F.greatest(offset, F.lit(1)), F.greatest(limit, F.lit(0)))

        def entry(x: Column, i: Column) -> Column:
            x = F.regexp_replace(x, "\r$", "")
            over = F.length(x) - LINE_CHARS
            cut = F.concat(F.left(x, F.lit(LINE_CHARS)), F.lit("… ["), over.cast("string"), F.lit(" chars truncated]"))
            return F.concat((offset + i).cast("string"), F.lit(": "), F.when(over > 0, cut).otherwise(x))

        def capped(e: Column) -> Column:
            fits = F.aggregate(
                e, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("open")),
                lambda s, x: F.when(s["open"] & (s["chars"] + F.length(x) + 1 <= OUTPUT_CHARS), F.struct((s["chars"] + F.length(x) + 1).alias("chars"), (s["n"] + 1).alias("n"), F.lit(True).alias("open")))
                .otherwise(F.struct(s["chars"].alias("chars"), s["n"].alias("n"), F.lit(False).alias("open"))),
            )
            return F.when(fits["n"] == F.size(e), joined(e)).otherwise(
                joined(F.concat(F.slice(e, 1, F.greatest(fits["n"], F.lit(0))), F.array(F.lit(f"… [output truncated at {OUTPUT_CHARS} chars]"))))
            )

        return F.when((offset >= 1) & (offset <= F.size(a)), let(F.transform(own, entry), capped))

    return let(text_lines(c), numbered)


def looks_windowed(offset: ColumnOrName, limit: ColumnOrName) -> Column:
    return col(offset).isNotNull() | col(limit).isNotNull()


def window_parameter(c: ColumnOrName) -> Column:
    """A positive whole number from text or number, else 0."""
    return F.greatest(F.coalesce(F.regexp_extract(col(c).cast("string"), r"^\s*\+?(\d{1,9})", 1).try_cast("int"), F.lit(0)), F.lit(0))


def head(c: ColumnOrName, n_lines: int = 30, n_chars: int = 2000) -> Column:
    return F.left(joined(F.slice(lines(c), 1, n_lines)), F.lit(n_chars))


def keep_last(c: ColumnOrName, n: int) -> Column:
    """The last lines and how many stand before them; null where there are no more than ``n``."""
    return let(text_lines(c), lambda a: F.when(
        F.size(a) > n, F.concat(joined(F.slice(a, -n, n)), F.lit("\n["), (F.size(a) - n).cast("string"), F.lit(" more lines]"))))


def dedup_runs(c: ColumnOrName) -> Column:
    """Each run of equal neighbouring lines as one line with its count."""

    def runs(a: Column) -> Column:
        at = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.try_element_at(a, i)), i)), lambda i: i.isNotNull())
        return let(at, lambda s: joined(F.transform(s, lambda i, k: _times(F.element_at(a, i + 1), F.coalesce(F.try_element_at(s, k + 2), F.size(a)) - i))))

    return let(lines(c), runs)


def _times(x: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(x, F.lit(" (×"), n.cast("string"), F.lit(")"))).otherwise(x)


def common_prefix(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common prefix, by halving: about log2 of the length comparisons."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(1), F.lit(31))
    found = F.aggregate(
        steps, F.struct(F.lit(0).alias("low"), n.alias("high")),
        lambda s, _: let(F.shiftright(s["low"] + s["high"] + 1, 1), lambda m: F.when(
            s["low"] >= s["high"], s).when(F.left(a, m) == F.left(b, m), F.struct(m.alias("low"), s["high"].alias("high")))
            .otherwise(F.struct(s["low"].alias("low"), (m - 1).alias("high")))),
    )
    return found["low"]
