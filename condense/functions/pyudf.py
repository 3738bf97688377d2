"""The few functions that need a loop over characters or lines: Arrow-batched and small.

Filter rows before they reach these: a pandas UDF sees every row of its batch.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col

_SIGNATURE = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub\s+)*(?:function|class|interface|enum|struct|impl|fn|func|trait|namespace|[\w<>\[\],:&*~ ]+\([^;{}]*\))[^;{}]*\{\s*$")
_DEFINITION = r"(?:function|class|interface|type|enum|struct|trait|def|fn|func|const|let|var)\s+{0}\b|^\s*(?:[\w<>\[\]]+\s+)*{0}\s*(?:=|\([^;]*\)\s*\{{)"


def _depths(text: str) -> list[int]:
    """Depth of braces behind each line; braces in strings, templates and comments do not count."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    out, depth = [], 0
    for line in bare.split("\n"):
        depth += line.count("{") - line.count("}")
        out.append(depth)
    return out


def skeleton_of(text: str | None) -> str | None:
    """Signatures of a brace language with their bodies as ``{ ... }``; the text itself where that is
    not shorter."""
    if not text:
        return text
    lines, depths, out, until = text.split("\n"), _depths(text), [], None
    for i, line in enumerate(lines):
        if until is not None:
            if depths[i] <= until:
                until = None
            continue
        if _SIGNATURE.match(line) and i + 1 < len(lines) and min(depths[i:]) <= depths[i] - 1:
            out.append(line.rstrip().removesuffix("{").rstrip() + " { ... }")
            until = depths[i] - 1
        else:
            out.append(line)
    new = "\n".join(out)
    return new if len(new) < len(text) else text


def symbol_of(text: str | None, name: str, most_lines: int = 160) -> str | None:
    """The definition of a name with its body, by braces or indentation; null if there is none."""
    if not text or name not in text:
        return None
    find = re.compile(_DEFINITION.format(re.escape(name)))
    lines = text.split("\n")
    at = next((i for i, line in enumerate(lines) if find.search(line)), None)
    if at is None:
        return None
    end = at
    if "{" in lines[at]:
        depths = _depths(text)
        base = depths[at - 1] if at else 0
        end = next((i for i in range(at, len(lines)) if depths[i] <= base), at)
    elif lines[at].rstrip().endswith(":"):
        indent = len(lines[at]) - len(lines[at].lstrip())
        for i in range(at + 1, len(lines)):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            end = i if lines[i].strip() else end
    return "\n".join(lines[at:end + 1][:most_lines])


def skeleton(c: ColumnOrName) -> Column:
    """Signatures only, see :func:`skeleton_of`."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(skeleton_of)

    return F.pandas_udf(run, "string")(col(c))


# What marks a line of code in a view.
_CODE = re.compile(r"^\s*[{\[(]|^\s*(?:export |import |function |const |let |async |pub fn|fn |def |func |interface |type |class )|[{}]\s*$|\t")


def shortened_code_of(text: str | None, least: int = 4) -> str | None:
    """Runs of at least ``least`` code lines as skeletons, all other lines as they are."""
    if not text:
        return text
    out: list[str] = []
    for code, own in itertools.groupby(text.split("\n"), lambda line: bool(_CODE.search(line))):
        lines = list(own)
        out.append(skeleton_of("\n".join(lines)) if code and len(lines) >= least else "\n".join(lines))
    return "\n".join(out)


def shortened_code(c: ColumnOrName, least: int = 4) -> Column:
    """See :func:`shortened_code_of`."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shortened_code_of(t, least))

    return F.pandas_udf(run, "string")(col(c))


def skeleton_of_json(text: str | None) -> str | None:
    """A JSON value with the names of types for its values; of an array, the type of its first value.  Null
    where the text is no JSON or stays as it is."""
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "object", list: "object", dict: "object"}

    def shape(v):
        if v is None:
            return "null"
        if isinstance(v, list):
            return f"[{kinds[type(v[0])]}]" if v else "[]"
        return {k: shape(x) for k, x in v.items()} if isinstance(v, dict) else kinds[type(v)]

    try:
        new = json.dumps(shape(json.loads(text or "")), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None
    return None if new == text else new


def skeleton_json(c: ColumnOrName) -> Column:
    """See :func:`skeleton_of_json`."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(skeleton_of_json)

    return F.pandas_udf(run, "string")(col(c))


def symbol(name: str, most_lines: int = 160):
    """Function of a column that extracts the definition of ``name``."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: symbol_of(t, name, most_lines))

    return lambda c: F.pandas_udf(run, "string")(col(c))


def edit_script(old: list[str], new: list[str], most: int = 3000) -> list[tuple[str, str, int, int]] | None:
    """A shortest line edit script ``(kind, line, old_line, new_line)``, kinds ``same, del, add``.  Common
    ends are trimmed first; null if what is left is longer than ``most`` lines."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    x, y = old[a:len(old) - b], new[a:len(new) - b]
    if max(len(x), len(y)) > most:
        return None
    out = [("same", t, i + 1, i + 1) for i, t in enumerate(old[:a])]
    i = j = 0
    for kind, n in _moves(x, y):
        for _ in range(n):
            if kind == "same":
                out.append(("same", x[i], a + i + 1, a + j + 1))
                i, j = i + 1, j + 1
            elif kind == "del":
                out.append(("del", x[i], a + i + 1, 0))
                i += 1
            else:
                out.append(("add", y[j], 0, a + j + 1))
                j += 1
    return out + [("same", t, len(old) - b + k + 1, len(new) - b + k + 1) for k, t in enumerate(old[len(old) - b:])]


def _moves(x: list[str], y: list[str]) -> list[tuple[str, int]]:
    """Greedy search along diagonals for the fewest insertions and deletions.  Of each round only the
    diagonals that it can reach are kept, as 32-bit numbers."""
    n, m = len(x), len(y)
    reach, trail = array("i", [0]) * (2 * (n + m) + 3), []
    zero = n + m + 1  # place of diagonal 0
    for d in range(n + m + 1):
        trail.append(reach[zero - d - 1:zero + d + 2])
        for k in range(-d, d + 1, 2):
            i = reach[zero + k + 1] if k == -d or (k != d and reach[zero + k - 1] < reach[zero + k + 1]) else reach[zero + k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[zero + k] = i
            if i >= n and i - k >= m:
                break
        else:
            continue
        break
    moves, i, j = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        k, v = i - j, trail[d]
        at = lambda q: v[q + d + 1]  # noqa: B023, E731
        pk = k + 1 if k == -d or (k != d and at(k - 1) < at(k + 1)) else k - 1
        pi = at(pk)
        pj = pi - pk
        while i > pi and j > pj and i > 0 and j > 0:
            moves.append(("same", 1))
            i, j = i - 1, j - 1
        if d:
            moves.append(("add" if pi == i else "del", 1))
        i, j = pi, pj
    return moves[::-1]


SCRIPT = "array<struct<kind:string,line:string,old_line:int,new_line:int>>"


def line_diff(old: ColumnOrName, new: ColumnOrName) -> Column:
    """Edit script of two texts; a final newline does not make a line."""

    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        cut = lambda t: t.removesuffix("\n").split("\n") if t else []
        names = ("kind", "line", "old_line", "new_line")
        scripts = (edit_script(cut(a), cut(b)) for a, b in zip(old, new, strict=True))
        return pd.Series([None if s is None else [dict(zip(names, r, strict=True)) for r in s] for s in scripts])

    return F.pandas_udf(run, SCRIPT)(col(old), col(new))
