"""What shell commands do: side effects, reads, scans; what remains when prefixes are gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col, let

# Programs that change something, and program with subcommand.
SIDE_EFFECT_PROGRAMS = [
    "rm", "mv", "cp", "mkdir", "touch", "dd", "chmod", "chown", "chgrp", "ln", "kill", "pkill", "killall", "taskkill", "shutdown", "reboot",
    "pmset", "ssh", "scp", "sftp", "rsync", "tee", "nc", "netcat", "telnet", "ping", "node", "nodejs", "python", "python2", "python3",
    "ruby", "perl", "php", "bash", "sh", "zsh", "fish", "source", "eval", "exec", "xargs", "open", "watch", "yes", "sleep", "time", "sudo",
    "doas", "launchctl", "systemctl", "terraform", "tofu", "kubectl", "aws", "gcloud", "az", "flyctl", "vercel", "netlify", "wrangler",
    "supabase", "firebase", "nodebrew", "bunx", "npx", "pnpx", "yarn", "pnpm",
]
SIDE_EFFECT_SUBCOMMANDS = {
    "git": [
        "push", "pull", "fetch", "commit", "reset", "rebase", "merge", "checkout", "switch", "restore", "revert", "clean", "cherry-pick",
        "rm", "stash", "apply", "am", "tag", "branch", "worktree", "config", "remote",
    ],
    "npm": ["install", "i", "ci", "publish", "unlink", "link", "init", "run", "test", "exec", "start", "stop"],
    "bun": ["install", "add", "remove", "publish", "link", "run", "test", "init", "update"],
    "pip": ["install", "uninstall"],
    "pip3": ["install", "uninstall"],
    "cargo": ["install", "add", "remove", "publish", "run", "test", "build", "bench"],
    "gem": ["install", "uninstall", "push"],
    "brew": ["install", "uninstall", "upgrade", "link", "unlink"],
    "apt": ["install", "remove", "upgrade"],
    "apt-get": ["install", "remove", "upgrade"],
    "docker": ["build", "push", "pull", "rm", "rmi", "tag", "commit", "compose", "system"],
    "make": ["install", "deploy", "release"],
    "tail": ["-f"],
}
_PAIRS = [f"{program} {sub}" for program, subs in SIDE_EFFECT_SUBCOMMANDS.items() for sub in subs]
_PREFIX = r"^(?:[A-Za-z_][A-Za-z0-9_]*=.*|sudo|doas|env|nohup|stdbuf|nice|command|exec|builtin|timeout)$"
_WRITES = r"(?:^|\s)(?:-X|--request|-d|--data|-T|--upload-file|-F|--form|-o|--output|-O|--post-data|--post-file)(?![A-Za-z0-9_])"
_CUTS = r"&&|\|\||;|\||\$\(|`|\n"
READERS = ["cat", "less", "more", "head", "tail", "bat", "nl", "wc", "grep", "rg", "sed", "awk"]
SCANNERS = ["ls", "find", "tree", "du", "fd"]


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \t]+", " "))


def _segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, _CUTS), lambda s: _squeezed(s)), lambda s: s != "")


def _bare(tokens: Column) -> Column:
    """Tokens from the program on: assignments, ``sudo`` and the like, and the time of ``timeout`` go."""
    start = F.struct(F.lit(0).alias("skip"), F.lit(True).alias("open"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        skip = s["open"] & (t.rlike(_PREFIX) | ((s["last"] == "timeout") & t.rlike("^[0-9]")))
        return F.struct(F.when(skip, s["skip"] + 1).otherwise(s["skip"]).alias("skip"), skip.alias("open"), t.alias("last"))

    return let(F.aggregate(tokens, start, step, lambda s: s["skip"]), lambda n: F.filter(tokens, lambda _, i: i >= n))


def is_side_effect(c: ColumnOrName) -> Column:
    """Whether any command of a line may change something."""

    def writes(segment: Column) -> Column:
        def judge(t: Column) -> Column:
            program, sub = F.try_element_at(t, F.lit(1)), F.coalesce(F.try_element_at(t, F.lit(2)), F.lit(""))
            return (F.size(t) > 0) & F.coalesce(
                program.isin(*SIDE_EFFECT_PROGRAMS) | F.concat_ws(" ", program, sub).isin(*_PAIRS) | (program.isin("curl", "wget") & segment.rlike(_WRITES)), F.lit(False))

        return let(_bare(F.split(segment, " ")), judge)

    return F.exists(_segments(F.coalesce(col(c), F.lit(""))), writes)


def effective_command(c: ColumnOrName) -> Column:
    """Without a leading ``cd ... &&``, exports and assignments."""
    out = F.regexp_replace(col(c), r"^(?:cd\s+[^;&|]*?|export\s+\S+=\S+|[A-Z_][A-Z0-9_]*=\S+\s*)\s*(?:&&|;|\||\n)", "")
    out = F.regexp_replace(out, r"^(?:[A-Z_][A-Z0-9_]*=\S+\s+)+", "")
    return F.trim(F.regexp_replace(out, r"^\s*(?:&&|;|\||\n)\s*", ""))


def _program(c: ColumnOrName) -> Column:
    return F.regexp_extract(_squeezed(effective_command(c)), r"^(\S+)", 1)


def reads_content(c: ColumnOrName) -> Column:
    return _program(c).isin(*READERS)


def scans_directory(c: ColumnOrName) -> Column:
    return _program(c).isin(*SCANNERS)


def only_path(c: ColumnOrName) -> Column:
    """The path that a command names, null if it names none or several."""
    words = F.split(_squeezed(effective_command(c)), " ")
    paths = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda t: ~t.startswith("-") & (t.contains("/") | t.rlike(r"^[A-Za-z0-9_~.-]+\.[A-Za-z0-9]{1,6}$")))
    return let(F.transform(paths, lambda p: F.regexp_replace(p, "^['\"]|['\"]$", "")), lambda p: F.when(F.size(p) == 1, F.try_element_at(p, F.lit(1))))


def resolve_tilde(c: ColumnOrName, home: str) -> Column:
    return F.regexp_replace(col(c), r"^~(?=/|$)", home.replace("$", "\\$"))


def match_key(tool: ColumnOrName, command: ColumnOrName, path: ColumnOrName) -> Column:
    """What identifies a repeated call: the squeezed command, or the path without a final slash."""
    return F.when(col(tool) == "shell_command", _squeezed(col(command))).otherwise(F.regexp_replace(col(path), "(?<=.)/+$", ""))


def never_elided(c: ColumnOrName, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(effective_command(c).startswith(p), F.lit(False))
    return out


def file_paths(c: ColumnOrName) -> Column:
    """Paths that prose mentions, quoted or bare, in order, each once."""
    quoted = F.regexp_extract_all(col(c), F.lit(r"""["'`]([A-Za-z0-9_~.@/\\-]*[A-Za-z0-9_-]\.[A-Za-z0-9]{1,8})["'`]"""), F.lit(1))
    bare = F.regexp_extract_all(col(c), F.lit(r"(?:^|[\s(])((?:~|\.{1,2})?/?(?:[A-Za-z0-9_.@-]+/)+[A-Za-z0-9_.@-]*\.[A-Za-z0-9]{1,8})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.concat(quoted, bare))
