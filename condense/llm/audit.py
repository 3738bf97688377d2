"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Texts are scanned in Arrow buffers: byte classes and prefix sums count words, capitals, symbols and
code points; hashes of a document's words are sorted, neighbours of one hash compared byte by byte,
and the runs counted.  What a document fails is a mask of five bits.  Orders are then a matter
of the masks' counts alone, of which there are at most 32 a part, so texts are read once for all 120.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .batches import parts, raw_bytes, released
from .bpe import utf8
from .columns import Plain
from .spans import byte_class, classes, counts, segments, spans

FILTERS = "ABCDE"
LEAST_WORDS = 100
#: Least share of distinct words, and most of capitals among code points, in hundredths.
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
SYMBOLS = b"#$%&*|"
#: Bytes of text that are scanned at a time.
BLOCK_BYTES = 4 << 20

_WORD = ~byte_class((9, 13), (32, 32))
_CAPITAL = byte_class((65, 90))
_SYMBOL = byte_class(*((x, x) for x in SYMBOLS))
_FIRST_BYTE = ~byte_class((0x80, 0xBF))


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each row."""
    first, size, row = spans(data, sizes, _WORD)
    order, new = classes(data, first, size, row)
    return np.bincount(row, minlength=sizes.size), np.bincount(row[order[new]], minlength=sizes.size)


def _distinct_of_long(data: np.ndarray) -> tuple[int, int]:
    """The same for one row, piece by piece; its distinct words are held."""
    n, seen = 0, set()
    for piece in segments(data, _WORD, BLOCK_BYTES):
        first, size, _ = spans(piece, np.array([piece.size]), _WORD)
        order, new = classes(piece, first, size)
        n += first.size
        whole, own = piece.tobytes(), order[new]
        seen.update(whole[i:i + k] for i, k in zip(first[own].tolist(), size[own].tolist(), strict=True))
    return n, len(seen)


def failures(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each row: whether it fails filter A, B, C and D."""
    if sizes.size == 1 and data.size > 2 * BLOCK_BYTES:
        words, distinct = (np.array([x]) for x in _distinct_of_long(data))
    else:
        words, distinct = _distinct(data, sizes)
    capitals, symbols, points = (counts(data, sizes, c) for c in (_CAPITAL, _SYMBOL, _FIRST_BYTE))
    bits = (words < LEAST_WORDS, 100 * distinct < DISTINCT_SHARE * words, 100 * capitals > CAPITAL_SHARE * points, symbols > 0)
    return sum(b.astype(np.int32) << i for i, b in enumerate(bits))


def measured(docs: DataFrame) -> DataFrame:
    """From ``id, part, text`` (bytes): ``id, part, failed`` (A to D) and ``sha`` of the text."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "part")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in parts(batch, 2, BLOCK_BYTES):
                data, sizes = raw_bytes(block.column(2))
                ends = np.cumsum(sizes)
                whole = memoryview(np.ascontiguousarray(data))
                sha = [hashlib.sha256(whole[a:b]).digest() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                failed = pa.array(failures(data, sizes), pa.int32())
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), failed, pa.array(sha, pa.binary())], ["id", "part", "failed", "sha"])

    return docs.select("id", "part", "text").mapInArrow(lambda b: released(run(b)), f"id {kinds['id']}, part {kinds['part']}, failed int, sha binary")


def _steps() -> list[dict]:
    """Every order with every step: the bit of the step's filter and those of the filters before."""
    return [
        {"filter_order": "".join(o), "step": i + 1, "bit": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in o[:i])}
        for o in itertools.permutations(FILTERS) for i, f in enumerate(o)
    ]


def interactions(masks: DataFrame) -> DataFrame:
    """From counts ``part, failed, n, good, toxic`` (``failed``: five bits) the counts of each part, order
    and step.  ``shapley`` needs no orders: of a document that fails k filters, each of them is the
    first in one k-th of all orders."""
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = masks.withColumn("s", F.explode(steps)).select("part", "failed", "n", "good", "toxic", "s.*")
    fails, gone = (F.col("failed").bitwiseAND(F.col(c)) != 0 for c in ("bit", "before"))
    orders = len(list(itertools.permutations(FILTERS)))
    share = F.expr(f"{orders} div bit_count(failed)")

    def total(when, value="n"):
        return F.sum(F.when(when, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("bigint")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"), total(fails, F.col("n") * share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley`` for every value of ``part_col`` (null: the empty string), order of the filters and step.

    Filters: fewer than 100 words (A), under 80 % distinct words (B), over 10 % capitals (C), one of
    ``#$%&*|`` (D), a text that a smaller id has in any part (E).  A null text is empty and an empty
    text fails A, and E like any other.  Rows that repeat an id count each; of repeated rows with the
    smallest id of their text none fails E, nor does a row without an id.  ``labels`` (``doc_id, quality,
    toxic``): an id counts as good or toxic where any of its rows says so.  Columns of other names are ignored; an
    empty table gives no rows.  Masks are written to the shared folder when this is called.
    """
    plain, marks = Plain(docs), Plain(labels)
    own = plain.df.select(
        F.col(plain.at(id_col)).alias("id"), F.coalesce(F.col(plain.at(part_col)).cast("string"), F.lit("")).alias("part"), utf8(plain.at(text_col)).alias("text")
    )
    rows = stored(measured(own), "audit-masks")
    # E without a join on the text: all rows but those with their text's smallest id fail it, and that id spreads a hot text
    first = rows.where("id is not null").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = marks.df.select(F.col(marks.at(id_col)).alias("id"), *(F.col(marks.at(c)).alias(c) for c in ("quality", "toxic")))
    marked = marks.where("id is not null and (quality = 1 or toxic = 1)").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = rows.join(first, ["id", "sha"], "left").join(marked, "id", "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    flagged = joined.select("part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"), "good", "toxic")
    masks = flagged.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return interactions(masks)
