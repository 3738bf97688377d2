"""Small helpers for building columns."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where lambdas inside ``body`` use it for
    every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(c: ColumnOrName) -> Column:
    """Text cut at newlines; an empty text is one empty line."""
    return F.split(col(c), "\n", -1)


def text_lines(c: ColumnOrName) -> Column:
    """Lines without the empty one behind a final newline."""
    return let(lines(c), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def joined(a: Column) -> Column:
    return F.array_join(a, "\n")


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found.  Those that begin at the start of the text are one pattern
    (flags hold in their own part only) behind one ``^``, so that all other places fail at once; the others are
    tried alone, which lets each skip ahead."""
    first = [p for p in patterns if p.removeprefix("(?i)").startswith("^")]
    rest = [p for p in patterns if p not in first]
    tests = ([c.rlike("^(?:" + "|".join(_behind_start(p) for p in first) + ")")] if first else []) + [c.rlike(p) for p in rest]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False)) if len(tests) != 1 else tests[0]


def _behind_start(pattern: str) -> str:
    """A pattern without its ``^``, which must hold for all of it."""
    body = pattern.removeprefix("(?i)")[1:]
    depth, escaped, in_class = 0, False, False
    for ch in body:
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "|" and depth == 0:
            raise ValueError(f"alternatives beside ^: {pattern}")
        else:
            depth += (ch == "(") - (ch == ")")
    return f"(?i:{body})" if pattern.startswith("(?i)") else f"(?:{body})"


def count_where(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test))


def word(pattern: str) -> str:
    """``pattern`` as a whole ASCII word; ``\\b`` would take accented letters for word characters."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def any_word(words: list[str]) -> str:
    """One of some words as a whole ASCII word, like :func:`word` of them: a class of their first letters rules most
    places out before anything looks back, and no two words are tried from the same letter on."""
    return f"(?=[{''.join(dict.fromkeys(w[0] for w in words))}])" + word(trie(words))


def trie(words: list[str]) -> str:
    """A pattern for one of some words, of which none is tried from its beginning after another."""
    tails: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        tails.setdefault(w[:1], []).append(w[1:])
    last = "?" if tails.pop("", None) else ""
    return "(?:" + "|".join(re.escape(a) + (trie(t) if t != [""] else "") for a, t in tails.items()) + ")" + last


def has_any(c: Column, parts: list[str]) -> Column:
    """Whether a text contains one of some strings: bytes are compared, which costs far less than a pattern."""
    return let(c, lambda t: functools.reduce(lambda a, b: a | b, (t.contains(x) for x in parts)))


def if_shorter(new: Column, old: Column) -> Column:
    """Fail open: the reduced text only where it is shorter."""
    return F.when(F.length(new) < F.length(old), new).otherwise(old)
