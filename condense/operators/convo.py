"""Conversations: observations, masking, epochs, frozen prefixes, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reduce, scores, text
from ..functions.base import ColumnOrName, col, joined, let, lines
from . import ordered, scan

PLACEHOLDER = "[condense] old tool output elided"
# Fixed value: lines that tell of a failure.
ERROR = r"(^|\n)\s*(error|Error|ERROR|ERR_|FAIL|FAILED|Failed|failed|✗|×|not ok|Traceback|panic|Exception|cannot |could not )"
# The sections of a state summary, in their order.
SECTIONS = [
    "Active Plan", "Current Phase", "TaskList Summary", "Session Decisions", "Constraints and Blockers", "Worker Topology",
    "Skills Invoked", "Editing Files", "Project Playbook", "Failed Attempts", "Recovery Notes",
]


def block_text(blocks: ColumnOrName) -> Column:
    """Text of an array of blocks ``type, text, content``."""
    return joined(F.transform(col(blocks), lambda b: F.coalesce(b["text"], b["content"], F.lit(""))))


def observations(messages: DataFrame, roles: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Messages that are tool outputs; summaries are none."""
    return messages.where(F.col("role").isin(*roles) & ~F.coalesce(F.col("is_summary"), F.lit(False)))


def placeholder(content: Column, hash_: Column | None = None) -> Column:
    ref = F.lit("") if hash_ is None else F.concat(F.lit(" [blob:"), F.left(hash_, F.lit(12)), F.lit("]"))
    return F.concat(F.lit(PLACEHOLDER + " ("), text.count_lines(content).cast("string"), F.lit(" lines, "), F.length(content).cast("string"), F.lit(" chars)"), ref)


def mask_verdict(content: Column, is_error: Column, least_chars: int) -> Column:
    return (
        F.when(F.coalesce(is_error, F.lit(False)), "error").when(F.coalesce(content, F.lit("")) == "", "small").when(content.startswith(PLACEHOLDER), "already")
        .when(F.length(content) < least_chars, "small").when(F.left(content, F.lit(4000)).rlike(ERROR), "error").otherwise("mask")
    )


def mask(messages: DataFrame, roles: tuple[str, ...] = ("tool",), keep_last: int = 8, polling: int = 16, least_chars: int = 500, least_savings: float = 0.1,
         least_tokens: int = 0, chars_per_token: float = 3.3) -> DataFrame:
    """Replace old observations by placeholders: of each conversation's observations all but the last
    ``keep_last``, in steps of ``polling``; the first, small and failed ones stay.

    ``messages``: ``conv_id, turn, role, content, is_error, is_summary``.  Adds ``verdict`` (null for what is
    not considered) and ``masked``; ``content`` is the new one.  A conversation whose savings or
    size are too small stays as it is.
    """
    is_obs = F.col("role").isin(*roles) & ~F.coalesce(F.col("is_summary"), F.lit(False))
    m = messages.withColumn("__obs", is_obs).withColumn("__bucket", ordered.bucket_of("turn"))
    one = F.col("__obs").cast("bigint")
    m = ordered.accumulated(m, ["conv_id"], [("turn", True)], {"__i": one}, {"__n": one, "__chars": F.length("content")})
    cut = F.greatest(F.floor((F.col("__n") - keep_last) / polling) * polling, F.lit(0))
    old = F.col("__obs") & (F.col("__i") <= cut)
    m = m.withColumn("verdict", F.when(old, F.when(F.col("__i") == 1, "first").otherwise(mask_verdict(F.col("content"), F.col("is_error"), least_chars))))
    hit = F.col("verdict") == "mask"
    m = ordered.accumulated(m, ["conv_id"], [], {}, {"__saved": F.when(hit, F.length("content")).otherwise(0)})
    worth = (F.col("__saved") >= least_savings * F.col("__chars")) & scores.mask_allowed(F.col("__chars") / chars_per_token, least_tokens)
    masked = F.coalesce(hit & worth, F.lit(False))
    content = F.when(masked, placeholder(F.col("content"), text.content_hash("content"))).otherwise(F.col("content"))
    return m.withColumn("masked", masked).withColumn("content", content).select(*messages.columns, "verdict", "masked")


def epochs(sizes: DataFrame, key: str = "conv_id", order: str = "turn", size: str = "size", share: float = 0.9, least_drop: int = 20_000) -> DataFrame:
    """``sizes`` with ``epoch``: it rises where the context falls below ``share`` of the peak since the last
    rise and by more than ``least_drop``.  The peak starts anew there, so the places of new epochs come
    from a scan of the functions that blocks of a conversation are (:class:`scan.ResetPeak`); a null size
    changes nothing."""

    return scan.scan(sizes, key, [order], scan.ResetPeak(size, share, least_drop))


def turns_since_epoch(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``rows`` with ``turns_since``: how many turns of its epoch came before each."""
    bucketed = rows.withColumn("__bucket", ordered.bucket_of(order))
    counted = ordered.accumulated(bucketed, [key, "epoch"], [(order, True)], {"turns_since": F.lit(1)}, {})
    return counted.select(*rows.columns, (F.col("turns_since") - 1).cast("int").alias("turns_since"))


def frozen_prefix(prefixes: DataFrame, key: str = "conv_id", order: str = "turn", prefix: str = "prefix") -> DataFrame:
    """``lcp_ratio`` with the turn before and ``cause``: ``frozen`` from 0.9 on, else ``compaction`` (another
    epoch), ``truncation`` (under 0.6 of the length) or ``mutation``."""
    w = Window.partitionBy(key, "__bucket").orderBy(order)
    rows = ordered.halo(prefixes, [key], [(order, True)], ordered.bucket_of(order), 1).withColumn("__before", F.lag(prefix).over(w))
    if "epoch" in prefixes.columns:
        rows = rows.withColumn("__moved", F.coalesce(F.lag("epoch").over(w) != F.col("epoch"), F.lit(False)))
    else:
        rows = rows.withColumn("__moved", F.lit(False))
    before = F.col("__before")
    ratio = F.when(before.isNull(), 1.0).when(F.length(before) == 0, 1.0).otherwise(text.common_prefix(before, prefix) / F.length(before))
    cause = F.when(ratio >= 0.9, "frozen").when(F.col("__moved"), "compaction").when(F.length(prefix) < F.length(before) * 0.6, "truncation").otherwise("mutation")
    return rows.where(~F.col("__halo")).select(*prefixes.columns, ratio.alias("lcp_ratio"), cause.alias("cause"))


def compress_last(messages: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Prose compression of each conversation's last message only."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("__last"))
    own = messages.join(last, "conv_id")
    hit = (F.col("turn") == F.col("__last")) & F.col("role").isin(*roles)
    small = own.where(hit).withColumn("content", reduce.compress_prose("content")["text"])
    return small.unionByName(own.where(~F.coalesce(hit, F.lit(False)))).select(*messages.columns)


def toc(blobs: DataFrame, entries: int = 24, chars: int = 80) -> DataFrame:
    """The first stored texts with their first lines."""
    first = F.left(F.element_at(lines("content"), 1), F.lit(chars))
    return blobs.where("kind = 'text'").orderBy("seq").limit(entries).select("hash", "seq", first.alias("line"), text.blob_ref("hash", "content").alias("ref"))


def skeletonise_blocks(content: Column, least: int = 4) -> Column:
    """Share of lines that stand in runs of at least ``least`` code lines: what a view would shorten."""
    def share(a: Column) -> Column:
        flags = F.transform(a, lambda x: reduce.is_code_line(x).cast("int"))
        run = lambda s, x: F.struct(F.when(x == 1, s["n"] + 1).otherwise(0).alias("n"), (s["t"] + F.when(x == 1, F.when(s["n"] + 1 == least, least).when(s["n"] + 1 > least, 1).otherwise(0)).otherwise(0)).alias("t"))
        return F.aggregate(flags, F.struct(F.lit(0).alias("n"), F.lit(0).alias("t")), run, lambda s: s["t"] / F.greatest(F.size(a), F.lit(1)))

    return let(lines(content), share)


def state_summary(values: dict[str, Column]) -> Column:
    """All sections, each a heading and its text; what is missing or blank is said not to be verified."""
    def one(name: str) -> Column:
        v = values[name] if name in values else F.lit(None).cast("string")
        return F.concat(F.lit(f"## {name}\n"), F.when(F.trim(v) != "", v).otherwise("(not verified)"))

    return joined(F.array(*map(one, SECTIONS)))


def collect_observations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, block, text, is_error`` of every tool output: the content of messages of role
    ``tool`` (``block`` is null), and blocks of type ``tool_result`` in messages of role ``user``.

    ``messages``: ``conv_id, turn, role, content, is_summary, blocks array<struct<type, text, content,
    is_error>>``.  Summaries, empty contents and other blocks give none.
    """
    own = messages.where(~F.coalesce("is_summary", F.lit(False)))
    plain = own.where((F.col("role") == "tool") & (F.length("content") > 0))
    plain = plain.select("conv_id", "turn", F.lit(None).cast("int").alias("block"), F.col("content").alias("text"), F.lit(False).alias("is_error"))
    blocks = own.where(F.col("role") == "user").select("conv_id", "turn", F.posexplode("blocks").alias("block", "b")).where("b.type = 'tool_result'")
    blocks = blocks.select("conv_id", "turn", "block", F.coalesce("b.content", "b.text").alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))
    return plain.unionByName(blocks.where(F.length("text") > 0))


def view_parts(calls: DataFrame, blobs: DataFrame, warm: int = 40, entries: int = 24, most_bytes: int = 1 << 20, chars: int = 80) -> DataFrame:
    """The parts of each session's view: ``session, part, seq, line``.

    ``warm``: the outputs of the last ``warm`` calls (``session, seq, tool, input, hash``), or a
    reference where the store lacks one; ``toc``: first lines of the first ``entries`` stored texts;
    ``ref``: notes on stored rows that are too large or binary.  Parts ``toc`` and ``ref`` belong to
    all sessions (null).
    """
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    last = calls.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= warm)
    held = last.join(blobs.select("hash", "content"), "hash", "left")
    ref = F.concat(F.lit("[blob:"), F.left("hash", F.lit(12)), F.lit(":"), F.length("input").cast("string"), F.lit("]"))
    body = F.when(F.col("content").isNotNull(), F.concat(F.lit("# tool: "), F.col("tool"), F.lit("\n"), F.col("content"))).otherwise(ref)
    kind = F.when(F.col("content").isNotNull(), "warm").otherwise("ref")
    parts = held.select("session", kind.alias("part"), F.col("seq").cast("bigint").alias("seq"), body.alias("line"))
    everywhere = F.lit(None).cast(calls.schema["session"].dataType).alias("session")
    first = F.left(F.element_at(lines("content"), 1), F.lit(chars))
    head = blobs.orderBy("seq").limit(entries).where("kind = 'text' and content is not null")
    head = head.select(everywhere, F.lit("toc").alias("part"), F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("  "), F.left("hash", F.lit(12)), F.lit(" "), F.col("size").cast("string"), F.lit(" chars"), F.when(first != "", F.concat(F.lit(" "), first)).otherwise("")).alias("line"))
    large = F.col("size") > most_bytes
    odd = blobs.where(large | (F.col("kind") == "binary")).select(
        everywhere, F.lit("ref").alias("part"), F.col("seq").cast("bigint").alias("seq"),
        F.format_string("[%s of %d bytes left out]", F.when(large, F.concat(F.lit("large "), F.col("kind"))).otherwise(F.col("kind")), "size").alias("line"),
    )
    return parts.unionByName(head).unionByName(odd)


def shorten_view(view: ColumnOrName, most_tokens: ColumnOrName | int = 0, chars_per_token: float = 3.3, least: int = 4) -> Column:
    """A view whose runs of ``least`` or more code lines are skeletons, cut to nine tenths of ``most_tokens`` if
    it is still larger (0: no limit)."""
    from ..functions.pyudf import shortened_code

    short = shortened_code(view, least)
    most = F.lit(most_tokens) if isinstance(most_tokens, int) else col(most_tokens)
    keep = F.greatest(F.lit(256), F.floor(most * chars_per_token * 0.9).cast("int"))
    over = (most > 0) & (text.estimate_tokens(short, chars_per_token) > most)
    return F.when(over, F.concat(F.left(short, keep), F.lit("\n[view trimmed to token budget]"))).otherwise(short)


def context_tokens(messages: DataFrame, chars_per_token: float = 3.3) -> DataFrame:
    """Characters and estimated tokens of each conversation."""
    chars = F.sum(F.length("content"))
    return messages.groupBy("conv_id").agg(chars.alias("chars"), F.round(chars / chars_per_token).cast("bigint").alias("tokens"))


def breaker(outcomes: DataFrame, key: str, order: str, failed: str, threshold: int = 3, rest: int = 5) -> DataFrame:
    """State of a circuit breaker after each key's outcomes: ``closed``; ``open`` after ``threshold`` failures
    in a row; ``half-open`` after ``rest`` further turns, closed again by a success, open by a failure.  An
    outcome that is null is a success; a null key is a key of its own.  A hot key is scanned by all tasks."""

    return scan.last(outcomes, key, [order], scan.Breaker(failed, threshold, rest), "state string, failures bigint, opened bigint")


def breaker_states(outcomes: DataFrame, key: str, order: str, failed: str, threshold: int = 3, rest: int = 5) -> DataFrame:
    """The same at every outcome: ``outcomes`` with ``state, failures, opened`` after it."""
    return scan.scan(outcomes, key, [order], scan.Breaker(failed, threshold, rest))
