"""Ordered digest rules for tool outputs: the first that applies gives the text.

A :class:`Rule` says which tools and commands it matches and what it does; :func:`digest` compiles a
list of them into one expression.  Arms are evaluated in order and only until one gives a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import count_by_first
from .base import ColumnOrName, any_of, col, has_any, joined, let, lines
from .commands import effective_command
from .text import dedup_runs, head, keep_last, strip_ansi


@dataclass(frozen=True)
class Rule:
    """``kind`` is one of ``ACTIONS``; ``args`` are its parameters.  ``command`` is matched against the
    command without its prefixes, ``not_command`` must not match."""

    name: str
    tool: str
    kind: str
    args: dict = field(default_factory=dict)
    command: str | None = None
    not_command: str | None = None


# Patterns of outputs and the order of rules.
SECURITY = r"(?i)vulnerabilit|severity|advisories|advisory|(^|[^a-z0-9_])CVE-|GHSA-|security"
FAILURE = (
    r"^(FAIL|Error|error|✗|×|not ok|test result:)|ERR_[A-Z0-9_]+|(^|[^A-Za-z0-9_])(ERROR|FAIL(ED|URE)?|panic|fatal|Exception|failed)([^A-Za-z0-9_]|$)"
    r"|Traceback \(most recent"
)
FOCUS = "(?i)error|fail|✗|×|not ok"
UP_TO_DATE = r"(?i)up to date|No dependencies to install or update|No changes\.|Already up[- ]to[- ]date|nothing to commit"
INSTALLED = (
    r"(?i)added \d+ packages|Installed \d+ packages|Installed \d+ (package|dependency)|Successfully installed|\d+ packages? (installed|added)"
    r"|Packages installed|All dependencies installed|✓ .* installed|installed [A-Za-z0-9_@./-]+@[A-Za-z0-9_.+-]+|Lockfile (up to date|written)|Writing lock file"
)
NOISE = [
    r"(?i)^\s*(npm|bun|pnpm|yarn) (WARN|notice|warn|info)\s", r"(?i)^\s*>\s*[A-Za-z0-9_@./-]+@", r"(?i)^\s*up to date", r"(?i)^\s*found 0 vulnerabilities",
    r"^\s*(⠹|⠼|⠸|⠙|⠦|⠧|⠇|⠏|✔|✖|⣾|⣽|⣻|⢿|⡿|⣟|⣯|⣷)\s", r"(?i)^\s*(Downloading|Extracting|Fetching|Resolving|Installing|Building)\s", r"^\s*[0-9.]+%[^\n]*$",
    r"(?i)^\s*(Compiling|Adding|Removing|Updating)\s+[A-Za-z0-9_@./-]+\s+", r"^\s*\[\d+/\d+\]", r"(?i)^\s*(make|makefile)(\[\d+\])?:\s*(Entering|Leaving) directory",
]
DIAGNOSTICS = [r"(?i)^\s*L?\d+:\d+\s+(information|hint|info)([^a-z0-9_]|$)", r"(?i)^\s*(no (diagnostics|problems|issues|errors)|0 (errors?|problems?|diagnostics))([^a-z0-9_]|$)"]

DEFAULT_RULES = [
    Rule("git-status", "^shell_command$", "git_status", {"most": 30}, command="^git status"),
    Rule("bash-squash", "^shell_command$", "squash", {"over": 6000, "template": "[Bash: exit {code}, {n} chars output]\n{head}"}, command="", not_command="^(cat|less|more|head|tail|bat)([^A-Za-z0-9_]|$)"),
    Rule("grep-group", "^(grep|glob)$", "group_squash", {"over": 1500, "per_file": 3, "files": 20}),
    Rule("dedup", "^(shell_command|grep)$", "dedup"),
    Rule("error-only", "^(shell_command|npm|pytest)$", "error_only", {"pattern": FAILURE}, command="(test|check|lint)"),
    Rule("diagnostics-strip", "^get_diagnostics$", "strip_lines", {"patterns": DIAGNOSTICS, "least": 300}),
    Rule("install-summary", "^shell_command$", "install_summary", {"least": 300}, command=r"^(npm|bun|pnpm|yarn|pip|poetry|pip3|uv)\s+(install|i|ci|add|lock|update|sync|pull)([^A-Za-z0-9_]|$)"),
    Rule("dev-noise-strip", "^shell_command$", "strip_lines", {"patterns": NOISE, "least": 400, "on_empty": "ok (no output)"}, command=r"^(npm|bun|pnpm|yarn|cargo|make|pip|poetry|gradle|mvn|dotnet|terraform|tofu|go (build|test|install))([^A-Za-z0-9_]|$)"),
    Rule("diff-summary", "^shell_command$", "diff_summary", {"context": 30, "least": 600}, command=r"(^|\s)(git\s+diff|diff\s|git\s+show)"),
]


# The same test as ``SECURITY``, beginning with a class of letters, and what a text needs to meet it.
_SECURITY = r"(?i)(?=[vsacg])(?:vulnerabilit|severity|advisor(?:ies|y)|(?<![a-z0-9_])CVE-|GHSA-|security)"
_SECURITY_PARTS = ["vulnerabilit", "severity", "advisor", "cve-", "ghsa-", "security"]


def squash(text: Column, over: int, template: str, tool: Column | None = None, path: Column | None = None, code: Column | None = None) -> Column:
    """A header and the first lines of a long output; null for shorter ones."""
    out = F.lit(template)
    values = {"n": F.length(text).cast("string"), "lines": F.size(lines(text)).cast("string"), "tool": tool, "path": path, "code": code}
    for k, v in values.items():
        unknown = F.lit("?")
        out = F.replace(out, F.lit(f"{{{k}}}"), unknown if v is None else F.coalesce(v.cast("string"), unknown))
    return F.when(F.length(text) > over, F.replace(out, F.lit("{head}"), head(text)))


def strip_lines(text: Column, patterns: list[str], least: int, on_empty: str | None = None) -> Column:
    """Without noise lines; what speaks of security always stays."""
    kept = let(has_any(F.lower(text), _SECURITY_PARTS), lambda risky: joined(F.filter(lines(text), lambda x: ~any_of(x, patterns) | (risky & x.rlike(_SECURITY)))))
    empty = F.when(F.length(text) > len(on_empty), F.lit(on_empty)) if on_empty is not None else F.lit(None).cast("string")
    return F.when(F.length(text) >= least, let(kept, lambda k: F.when(F.length(k) == 0, empty).when(F.length(k) < F.length(text), k)))


def install_summary(text: Column, least: int) -> Column:
    """Distinct verdicts of a package manager, then its security lines."""

    def verdicts(a: Column) -> Column:
        # each line is asked for security once
        asked = F.transform(a, lambda x: F.struct(x.alias("x"), x.rlike(_SECURITY).alias("risky")))
        return let(asked, said)

    def said(a: Column) -> Column:
        up_to_date, installed = (has_any(F.lower(text), parts) for parts in (["up to date", "up-to-date", "up to-date", "up-to date", "no ", "nothing to commit"], ["added ", "install", "package", "lock file ", "lockfile ", "writing lock"]))
        told = lambda gates: F.filter(F.transform(F.filter(a, lambda r: ~r["risky"]), lambda r: F.when(gates["u"] & r["x"].rlike(UP_TO_DATE), "ok (up to date)").when(gates["i"] & r["x"].rlike(INSTALLED), F.trim(r["x"]))), lambda x: x.isNotNull())
        risky = F.transform(F.filter(a, lambda r: r["risky"] & ~r["x"].rlike(r"(?i)(^|[^a-z0-9_])0\s+vulnerabilit")), lambda r: F.trim(r["x"]))
        parts = F.concat(F.array_distinct(let(F.struct(up_to_date.alias("u"), installed.alias("i")), told)), risky)
        return let(parts, lambda p: let(joined(p), lambda t: F.when((F.size(p) > 0) & (F.length(t) < F.length(text)), t)))

    return F.when(F.length(text) >= least, let(lines(text), verdicts))


def error_only(text: Column, pattern: str) -> Column:
    return let(lines(text), lambda a: let(F.filter(a, lambda x: x.rlike(pattern)), lambda k: F.when((F.size(k) > 0) & (F.size(k) < F.size(a)), joined(k))))


# Fixed value: a line of search results.
MATCH_LINE = r"^([^:]+):([0-9]+):(.*)$"


def group_squash(text: Column, over: int = 1500, per_file: int = 3, files: int = 20) -> Column:
    """Search results by file in order of appearance: the first matches of the first ``files + 1`` files.
    Struct ``text, matches, shown_files, all_files``."""

    def build(m: Column) -> Column:
        places = F.transform(m, lambda x: F.regexp_extract(x, MATCH_LINE, 1))

        def render(groups: Column) -> Column:
            shown = F.slice(groups, 1, files + 1)
            of = lambda g: F.transform(F.slice(F.filter(m, lambda x: F.regexp_extract(x, MATCH_LINE, 1) == g["key"]), 1, per_file), lambda x: F.concat(F.lit(" "), F.left(x, F.lit(200))))
            body = F.flatten(F.transform(shown, lambda g: F.concat(F.array(F.concat(F.lit(" "), g["key"], F.lit(":"))), of(g))))
            top = F.concat(F.lit("[Search results: "), F.size(m).cast("string"), F.lit(" matches in "), F.size(shown).cast("string"), F.lit(" files]"))
            return F.struct(
                joined(F.concat(F.array(top), body)).alias("text"), F.size(m).cast("bigint").alias("matches"),
                F.size(shown).cast("bigint").alias("shown_files"), F.size(groups).cast("bigint").alias("all_files"),
            )

        return F.when(F.size(m) > 0, let(count_by_first(places), render))

    return F.when(F.length(text) > over, let(F.filter(lines(text), lambda x: x.rlike(MATCH_LINE)), build))


def git_status(text: Column, most: int) -> Column:
    """Branch, the first entries, and how many more there are."""
    trimmed = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    # Entries of a status, short and long, and its other lines.
    short, long_ = r"^([ MADRCU?!]{1,2})\s+(.+)$", r"^(modified|new file|deleted|renamed|typechange|untracked):\s+(.+)$"
    skip = r"^(Untracked files|Changes to be committed|Changes not staged for commit|no changes added|Your branch|use \"git|\(use |\(git )"

    def build(a: Column) -> Column:
        is_head = lambda x: x.startswith("## ") | x.startswith("On branch ")
        heads = F.filter(a, is_head)
        branch = let(F.try_element_at(heads, F.lit(-1)), lambda b: F.when(b.startswith("## "), F.trim(F.element_at(F.split(F.substr(b, F.lit(4)), r"\.\.\."), 1))).otherwise(F.trim(F.substr(b, F.lit(11)))))
        rest = F.transform(F.filter(a, lambda x: ~is_head(x)), lambda x: F.struct(x.alias("x"), (x.rlike(short) | x.rlike(long_)).alias("entry")))
        entry = lambda x: F.when(x.rlike(short), F.concat_ws(" ", F.coalesce(F.nullif(F.trim(F.regexp_extract(x, short, 1)), F.lit("")), F.lit("??")), F.regexp_extract(x, short, 2))).when(
            x.rlike(long_), F.concat_ws(" ", F.regexp_extract(x, long_, 1), F.element_at(F.split(F.regexp_extract(x, long_, 2), " -> "), 1)))

        def render(r: Column) -> Column:
            # only those that are shown are taken apart
            e = F.filter(r, lambda x: x["entry"])
            other = F.filter(r, lambda x: ~x["entry"] & ~x["x"].rlike(skip))
            return let(e, lambda e: let(F.size(other), lambda n: shown(e, n)))

        def shown(e: Column, others: Column) -> Column:
            more = F.greatest(F.size(e) - most, F.lit(0)) + others
            none = F.array().cast("array<string>")
            parts = F.concat(
                F.when(F.coalesce(branch, F.lit("")) != "", F.array(F.concat(F.lit("branch: "), branch))).otherwise(none), F.transform(F.slice(e, 1, most), lambda x: entry(x["x"])),
                F.when(more > 0, F.array(F.concat(F.lit("["), more.cast("string"), F.lit(" more entries]")))).otherwise(none),
            )
            ok = (F.size(e) > 0) | (F.coalesce(branch, F.lit("")) != "")
            return let(joined(parts), lambda t: F.when(ok & (F.length(t) < F.length(text)), t))

        return let(rest, render)

    return let(trimmed, build)


# Fixed value: lines of a patch that are no context.
CHANGE_LINE = r"^(@@ |[+-]|<<<<<<<|=======|>>>>>>>|diff --git|index )"


def diff_summary(text: Column, context: int, least: int) -> Column:
    """A patch with at most ``context`` context lines behind each change; the rest is counted."""

    def build(a: Column) -> Column:
        kinds = F.transform(a, lambda x: F.when(x.rlike(CHANGE_LINE), "c").when(x.startswith(" "), "x").otherwise("o"))

        def blocks(k: Column) -> Column:
            at = F.filter(F.transform(k, lambda x, i: F.when((i == 0) | (x == "c"), i)), lambda i: i.isNotNull())

            def render(s: Column) -> Column:
                def block(i: Column, j: Column) -> Column:
                    end = F.coalesce(F.try_element_at(s, j + 2), F.size(a))
                    own = F.transform(F.slice(a, i + 1, end - i), lambda x, o: F.struct(x.alias("x"), F.element_at(k, i + o + 1).alias("k")))

                    def cut(b: Column) -> Column:
                        ctx = F.filter(F.transform(b, lambda r, o: F.when(r["k"] == "x", o)), lambda o: o.isNotNull())
                        last = F.coalesce(F.try_element_at(ctx, F.lit(context)), F.lit(1 << 30))
                        kept = F.filter(b, lambda r, o: (r["k"] != "x") | (o <= last))
                        over = F.size(ctx) - context
                        note = F.when(over > 0, F.array(F.concat(F.lit(" …["), over.cast("string"), F.lit(" context lines]")))).otherwise(F.array().cast("array<string>"))
                        return F.concat(F.transform(kept, lambda r: r["x"]), note)

                    return let(own, cut)

                return let(joined(F.flatten(F.transform(s, block))), lambda t: F.when(F.length(t) < F.length(text), t))

            return let(at, render)

        return let(kinds, blocks)

    return F.when(F.length(text) >= least, let(lines(text), build))


def failure_focus(text: Column) -> Column:
    """The first lines that name a failure, else the beginning."""
    kept = F.slice(F.filter(lines(text), lambda x: x.rlike(FOCUS)), 1, 20)
    body = let(kept, lambda k: F.when(F.size(k) > 0, joined(k)).otherwise(F.left(text, F.lit(2000))))
    return let(body, lambda b: F.concat(F.lit("[tool failed — "), F.length(b).cast("string"), F.lit(" chars]\n"), b))


def stats(text: Column, pattern: str, template: str) -> Column:
    """A template with the pattern's first group as ``{n}``; null where it is not found."""
    return F.when(text.rlike(pattern), F.replace(F.lit(template), F.lit("{n}"), F.regexp_extract(text, pattern, 1)))


def strip(text: Column, pattern: str) -> Column:
    """Without the first match of a pattern."""
    found = F.regexp_substr(text, F.lit(pattern))
    return F.when(found.isNotNull(), let(F.instr(text, found), lambda p: F.concat(F.left(text, p - 1), F.substr(text, p + F.length(found)))))


def structure(text: Column) -> Column:
    """The types of a JSON value instead of its values; null where the text is no JSON."""
    from .pyudf import skeleton_json

    return skeleton_json(text)


def apply(rule: Rule, tool: Column, text: Column, path: Column, code: Column) -> Column:
    """The rule's text, null where its action gives none."""
    k, a = rule.kind, rule.args
    if k == "squash":
        return squash(text, a["over"], a["template"], tool, path, code)
    if k == "group_squash":
        return group_squash(text, **a)["text"]
    if k == "dedup":
        return let(dedup_runs(text), lambda t: F.when(t != text, t))
    if k == "keep_last":
        return keep_last(text, a["lines"])
    return ACTIONS[k](text, **a)


ACTIONS = {
    "git_status": git_status, "squash": squash, "group_squash": group_squash, "dedup": dedup_runs, "error_only": error_only, "strip_lines": strip_lines,
    "install_summary": install_summary, "diff_summary": diff_summary, "keep_last": keep_last, "stats": stats, "strip": strip, "structure": structure,
}


def digest(tool: ColumnOrName, command: ColumnOrName, text: ColumnOrName, is_error: ColumnOrName | None = None, path: ColumnOrName | None = None,
           code: ColumnOrName | None = None, rules: list[Rule] | None = None) -> Column:
    """Struct ``text, rule, saved_chars``; all null or 0 where the output stays as it is."""
    tool, text = col(tool), col(text)
    path = col(path) if path is not None else F.lit(None).cast("string")
    code = col(code) if code is not None else F.lit(None).cast("string")
    failed = F.coalesce(col(is_error), F.lit(False)) if is_error is not None else F.lit(False)

    def out(t: Column, name: str | Column) -> Column:
        return F.struct(t.alias("text"), (name if isinstance(name, Column) else F.lit(name)).alias("rule"), (F.length(text) - F.length(t)).cast("bigint").alias("saved_chars"))

    def chain(clean: Column, cmd: Column) -> Column:
        arms = []
        for r in rules if rules is not None else DEFAULT_RULES:
            test = tool.rlike(r.tool)
            if r.command is not None:
                test = test & cmd.isNotNull() & cmd.rlike(r.command)
            if r.not_command is not None:
                test = test & ~cmd.rlike(r.not_command)
            arms.append(F.when(test, _named(apply(r, tool, clean, path, code), r.name)))
        done = F.coalesce(*arms, F.when(clean != text, F.struct(clean.alias("t"), F.lit("strip-ansi").alias("r"))))
        return let(done, lambda d: F.when(d.isNotNull(), out(d["t"], d["r"])).otherwise(none))

    null = F.lit(None).cast("string")
    none = F.struct(null.alias("text"), null.alias("rule"), F.lit(0).cast("bigint").alias("saved_chars"))
    clean = F.when(tool == "shell_command", strip_ansi(text)).otherwise(text)
    body = let(F.struct(clean.alias("t"), effective_command(col(command)).alias("c")), lambda s: chain(s["t"], s["c"]))
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(
        failed, let(failure_focus(text), lambda t: F.struct(t.alias("text"), F.lit("failure-focus").alias("rule"), F.lit(0).cast("bigint").alias("saved_chars")))
    ).otherwise(body)


def _named(t: Column, name: str) -> Column:
    return let(t, lambda x: F.when(x.isNotNull(), F.struct(x.alias("t"), F.lit(name).alias("r"))))
