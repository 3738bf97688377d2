"""Near-duplicate groups by DartMinHash and banded joining.

A document is the weighted set of its five-word shingles, a shingle's weight being how often it
occurs.  Each unit of weight is a strip of the element's region, on which darts fall as a Poisson
process in rank: hashes of (shingle, strip, throw) give the gaps between them.  Darts beyond the
rank that the document's total weight calls for are never thrown, so a long document costs about
one hash a shingle.  Each dart hits one coordinate of the signature, and the dart of lowest rank
stays.  Documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Signatures are cut into bands; documents that share a band are compared by their exact
similarity.  Within a band's bucket every member is compared with the one of smallest id.  What
then stays in different groups goes through an exact prefix filter: two sets of a given overlap
share one of their rarest elements, so only documents that share such an element, and whose other
elements could still make up the overlap, are compared.  No bucket is paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import wordhash as wh
from .batches import byte_rows, parts, released
from .bpe import utf8
from ..sources.scratch import drop_stored, stored

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BLOCK = 2 << 20  # bytes of text at a time
DARTS = 500_000  # darts held at a time, about
#: Elements (bytes) that one task holds while it looks for rare ones.
PREFIX_BYTES = 8 << 20
_U = np.uint64
_STRIP, _THROW = _U(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements (shingle, strip) of all texts as 64-bit hashes, sorted within each text; how many
    each text has; and a 64-bit hash of each text's words.  A text of fewer than ``words`` words
    is one shingle."""
    h, counts = wh.words(texts)
    w = wh.Windows(h)
    first = np.cumsum(counts) - counts
    whole = w.hashes(first, counts) if counts.size else np.zeros(0, _U)
    size = np.where(counts > 0, np.minimum(counts, words), 0)
    n = np.where(counts > 0, counts - size + 1, 0)
    owner = np.repeat(np.arange(counts.size), n)
    start = first[owner] + np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
    s = w.hashes(start, size[owner])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])] if s.size else np.zeros(0, bool)
    at = np.flatnonzero(new)
    strip = np.arange(s.size) - np.repeat(at, np.diff(np.r_[at, s.size]))
    e = wh.mix(s + strip.astype(_U) * _STRIP)
    return e[np.lexsort((e, owner))], n, whole


def signatures(elements: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Ids of the earliest dart in each of ``k`` coordinates for each text (rows), zeros for texts
    without elements; a bounded number of texts at a time."""
    out = np.zeros((counts.size, k), _U)
    ends = np.cumsum(counts)
    cost = np.cumsum(counts + int(k * np.log(k) + 2 * k))
    at = 0
    while at < counts.size:
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + DARTS, "right")))
        out[at:end] = _signatures(elements[ends[at] - counts[at]:ends[end - 1]], counts[at:end], k)
        at = end
    return out


def _signatures(elements: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Ranks go up to where about ``k ln k + 2 k`` darts are expected, and are doubled for texts that
    still have an empty coordinate."""
    out = np.zeros((counts.size, k), _U)
    rest, owner = np.flatnonzero(counts > 0), np.repeat(np.arange(counts.size), counts)
    reach = (k * np.log(k) + 2 * k) / np.maximum(1, counts)
    while rest.size:
        mine = np.zeros(counts.size, bool)
        mine[rest] = True
        e = elements[mine[owner]]
        o = owner[mine[owner]]
        rank = np.zeros(e.size)
        darts: list[tuple] = []
        throw = 0
        while e.size:
            throw += 1
            u = wh.mix(e + _U(throw * _THROW % 2**64))
            rank = rank - np.log(((u >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            fine = rank < reach[o]
            e, o, rank, u = e[fine], o[fine], rank[fine], u[fine]
            ids = wh.mix(u)
            darts.append((o * k + (ids % _U(k)).astype(np.int64), rank, ids))
        place, ranks, ids = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.argsort(-ranks, kind="stable")
        flat = np.zeros(out.size, _U)
        hit = np.zeros(out.size, bool)
        flat[place[order]] = ids[order]  # the last to be set has the lowest rank
        hit[place] = True
        full = hit.reshape(out.shape).all(axis=1)
        done = rest[full[rest]]
        out[done] = flat.reshape(out.shape)[done]
        rest = rest[~full[rest]]
        reach[rest] *= 2
    return out


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each signature, different between bands."""
    sig = signature.reshape(len(signature), n_bands, rows)
    out = np.full(sig.shape[:2], 1, _U) * np.arange(1, n_bands + 1, dtype=_U)
    for r in range(rows):
        out = wh.mix(out * _STRIP + sig[:, :, r])
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, words bigint, copy binary, bands array<bigint>`` of every whole text; documents with
    equal words have equal ``copy``.  ``bands`` is empty for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 1, BLOCK)):
            e, n, whole = shingles(batch.column(1).to_pylist())
            b = bands(signatures(e, n, n_bands * rows), n_bands, rows).view(np.int64)
            sums = np.add.reduceat(np.append(e, _U(0)), np.minimum(np.cumsum(n) - n, e.size)) if n.size else e
            has = n > 0
            copy = np.stack((whole, sums, n.astype(_U)), axis=1).astype("<u8")[has]
            copies = byte_rows(copy.view("u1").ravel(), np.full(len(copy), 24)).take(pa.array(np.cumsum(has) - 1, mask=~has))
            ends = np.concatenate(([0], np.cumsum(np.where(has, n_bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(b[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), copies, lists], ["id", "elements", "copy", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("text")).mapInArrow(
        lambda b: released(run(b)), "id bigint, elements bigint, copy binary, bands array<bigint>"
    )


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of elements, which is that of the weighted shingles."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both)


def similar(full: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of ``a, b, e_a, e_b`` with a similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return full.select("a", "b", "e_a", "e_b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, elements: DataFrame, least: float, firsts: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` of a similarity of at least ``least``.  ``elements``: ``id, e binary``; ``firsts``: those
    that can be ``a``."""
    left = elements.select(F.col("id").alias("b"), F.col("e").alias("e_b"))
    right = (elements if firsts is None else firsts).select(F.col("id").alias("a"), F.col("e").alias("e_a"))
    # the side with hot keys (a) is joined last, when its rows have their full size and Spark can split them by it
    return similar(pairs.hint("merge").join(left, "b").hint("merge").join(right, "a"), least)


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id in the component of each id in ``edges`` (``a``, ``b``).
    Every round hooks each component to the least of its neighbours and then halves the paths;
    components whose neighbours are all larger stay, so few rounds are needed."""
    edges = stored(edges.select("a", "b"), "components-edges")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = stored(ids.withColumn("root", F.col("id")), "components-labels")
    while True:
        la, lb = (labels.select(F.col("id").alias(x), F.col("root").alias(f"r_{x}")) for x in "ab")
        between = stored(
            edges.hint("merge").join(lb, "b").hint("merge").join(la, "a").where("r_a <> r_b")
            .select(F.greatest("r_a", "r_b").alias("a"), F.least("r_a", "r_b").alias("b")).distinct(),
            "components-between",
        )
        drop_stored(edges)
        hooks = between.groupBy("a").agg(F.min("b").alias("to"))
        if hooks.isEmpty():
            drop_stored(between)
            return labels
        hooks = stored(hooks, "components-hooks")
        while True:  # pointer jumping
            nxt = hooks.select(F.col("a").alias("to"), F.col("to").alias("further"))
            step = hooks.hint("merge").join(nxt, "to", "left").select("a", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            jumped = stored(step, "components-hooks")
            drop_stored(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        roots = hooks.select(F.col("a").alias("root"), F.col("to").alias("new"))
        further = stored(labels.hint("merge").join(roots, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "components-labels")
        drop_stored(labels, hooks)
        labels, edges = further, between


def sharing_rare(sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of sets (``id, e binary, root``) of different roots that may have a similarity of
    ``least`` or more; none that has is left out.

    With elements ordered from rare to frequent, a set and a larger one (ties by id) that are
    similar share an element among the first ``n - 2 least / (1 + least) n + 1`` of the one and the
    first ``n - least n + 1`` of the other.  A pair is given once, at its first common element, if
    what follows there can still reach the overlap.  Elements that no other set has cannot be
    shared, so sets with too few others are left out.
    """
    size = sets.agg(F.coalesce(F.sum(F.octet_length("e")), F.lit(0))).first()[0]
    n = int(max(1, -(-size // PREFIX_BYTES), 2 * sets.sparkSession.sparkContext.defaultParallelism))
    chunked = sets.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition(n, "chunk")

    def elements_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        own = [np.frombuffer(x, "<u8") for x in table.column("e").to_pylist()]
        values, at, count = np.unique(np.concatenate(own) if own else np.zeros(0, _U), return_inverse=True, return_counts=True)
        return own, values, at, count

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, values, _, count = elements_of(table)
        return exchange.packed(values, n, key[0].as_py(), n_own=count.astype("<u4"))

    def counted(table: pa.Table) -> pa.Table:
        values, sizes = exchange.received(table, "values", "<u8")
        own, _ = exchange.received(table, "n_own", "<u4")
        _, at = np.unique(values, return_inverse=True)
        return exchange.reply(table, sizes, np.minimum(np.bincount(at, own)[at], 0xFFFF).astype("<u2"))

    def rare(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        own, values, at, _ = elements_of(table)
        often = exchange.replied(replies, "<u2", values.size)[at]
        ends = np.cumsum([x.size for x in own])
        keep, places, hashes = [], [], []
        for i, (x, end) in enumerate(zip(own, ends.tolist(), strict=True)):
            f = often[end - x.size:end]
            order = np.lexsort((x, f))
            alone = int((f <= 1).sum())  # these come first and nobody shares them
            prefix = x.size - int(np.ceil(least * x.size - 1e-9)) + 1
            if alone < prefix:
                keep.append(i)
                places.append(list(range(alone, prefix)))
                hashes.append(x[order[alone:prefix]].view("<i8").tolist())
        left = table.take(pa.array(keep, pa.int64()))
        return pa.table({
            "id": left.column("id"), "root": left.column("root"), "n": pa.array([own[i].size for i in keep], pa.int64()),
            "places": pa.array(places, pa.list_(pa.int32())), "hashes": pa.array(hashes, pa.list_(pa.int64())),
        })

    sent = chunked.groupBy("chunk").applyInArrow(send, "group int, chunk int, values binary, n_own binary")
    replies = sent.groupBy("group").applyInArrow(counted, "chunk int, group int, numbers binary")
    made = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rare, "id bigint, root bigint, n bigint, places array<int>, hashes array<bigint>")
    made = stored(made, "near-prefixes")
    rows = made.select("id", "root", "n", "hashes", F.explode(F.arrays_zip("places", "hashes")).alias("p")).select("id", "root", "n", "hashes", F.col("p.places").alias("p"), F.col("p.hashes").alias("h"))
    both = 2 * least / (1 + least)
    small = rows.where(F.col("p") < F.col("n") - F.ceil(both * F.col("n") - 1e-9) + 1).select(*(F.col(c).alias(f"{c}_x") for c in rows.columns))
    large = rows.select(*(F.col(c).alias(f"{c}_y") for c in rows.columns))
    c = F.col
    need = F.ceil(least / (1 + least) * (c("n_x") + c("n_y")) - 1e-9)
    fits = (
        (c("h_x") == c("h_y")) & (c("root_x") != c("root_y")) & ((c("n_x") < c("n_y")) | ((c("n_x") == c("n_y")) & (c("id_x") < c("id_y"))))
        & (c("n_x") >= least * c("n_y")) & (F.least(c("n_x") - c("p_x"), c("n_y") - c("p_y")) >= need)
        & (F.element_at(F.array_intersect("hashes_x", "hashes_y"), 1) == c("h_x"))
    )
    # a merge: each exploded row carries its list, which Spark takes for the size of the written table, so that it
    # would broadcast what is many times as large
    return small.hint("merge").join(large, fits).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
                    n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose five-word shingles have a weighted Jaccard similarity of ``least`` or
    more, directly or through others.

    Returns ``id_col bigint, class_id bigint, representative bigint, n_shingles bigint``: a row per
    row of ``docs``; ``class_id`` is the smallest id of the group, ``representative`` the smallest
    id with the same words.  A document without words (null text) is alone in its class, as is one
    without an id (its class is null); a text of one to four words is near only to its copies; all
    texts of one id are one document.  Other columns are ignored.
    """
    rows_of = stored(sketch(docs, id_col, text_col, n_bands, rows), "near-sketch")
    distinct = rows_of.where("copy is not null and id is not null").groupBy("copy").agg(F.min(F.struct("id", "elements", "bands")).alias("r"))
    # one row for each different sequence of words
    texts = stored(distinct.select("copy", F.col("r.id").alias("id"), F.col("r.bands").alias("bands")), "near-texts")
    # all joins of tables that grow with the input are merges whatever the sizes: the plan is the same for small
    # and large inputs, and Spark can split hot keys, as both sides are written tables
    keys = texts.select("id", F.explode("bands").alias("band"))
    buckets = stored(keys.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("band", "pivot"), "near-buckets")
    members = stored(keys.hint("merge").join(buckets, "band").select("band", "pivot", "id"), "near-members")
    drop_stored(buckets)

    # each text and the pivot with which it shares most buckets; a pivot is always smaller, so these pairs are a forest
    stars = stored(members.where("id <> pivot").groupBy("pivot", "id").agg(F.count("*").alias("shared")), "near-stars")
    best = stars.groupBy("id").agg(F.max(F.struct("shared", -F.col("pivot"))).alias("m")).select("id", (-F.col("m.col2")).alias("a"))
    pivots = members.select(F.col("pivot").alias("id")).distinct().withColumn("is_pivot", F.lit(True))
    asked = best.hint("merge").join(pivots, "id", "full").select("id", "a", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"))
    again = docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("text"))

    def elements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 1, BLOCK)):
            e, n, _ = shingles(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_rows(e.astype("<u8").view("u1"), 8 * n), batch.column(2), batch.column(3)], ["id", "e", "a", "is_pivot"])

    # the elements of all texts that share a bucket with another
    once = again.hint("merge").join(asked, "id").groupBy("id", F.xxhash64("text"), "a", "is_pivot").agg(F.first("text").alias("text"))
    held = once.select("id", "text", "a", "is_pivot").mapInArrow(lambda b: released(elements_of(b)), "id bigint, e binary, a bigint, is_pivot boolean")
    elements = stored(held, "near-elements")
    centres = elements.where("is_pivot")
    own = elements.where("a is not null").select("a", F.col("id").alias("b"), F.col("e").alias("e_b"))
    first = stored(similar(own.hint("merge").join(centres.select(F.col("id").alias("a"), F.col("e").alias("e_a")), "a"), least), "near-edges")
    roots = components(first)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        ra, rb = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r_{x}")) for x in "ab")
        joined = pairs.hint("merge").join(rb, "b", "left").hint("merge").join(ra, "a", "left")
        return joined.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")

    done = elements.where("a is not null").select("a", F.col("id").alias("b"))
    other = stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")).hint("merge").join(done, ["a", "b"], "left_anti")
    pairs = stored(apart(other, roots), "near-pairs")
    second = verified(pairs, elements, least, centres)
    edges = stored(first.union(second), "near-edges")
    drop_stored(first, pairs, roots, stars)
    roots = components(edges)

    # what is left: members of one bucket in different groups
    mine = members.hint("merge").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    mixed = stored(mine.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band"), "near-mixed")
    open_ = stored(mine.hint("merge").join(mixed, "band").select("id", "root").distinct(), "near-open")
    sets = stored(elements.select("id", "e").hint("merge").join(open_, "id").select("id", "root", "e"), "near-sets")
    drop_stored(elements, members, mixed, open_)
    third = stored(verified(stored(sharing_rare(sets, least), "near-pairs"), sets, least), "near-edges")
    drop_stored(sets)
    if not third.isEmpty():
        old, roots = roots, components(edges.union(third))
        drop_stored(old)

    named = texts.select("copy", "id").hint("merge").join(roots, "id", "left").select("copy", F.col("id").alias("representative"), F.coalesce("root", "id").alias("class_id"))
    named = stored(named, "near-classes")
    drop_stored(texts, roots, edges, third)
    return rows_of.select("id", "elements", "copy").hint("merge").join(named, "copy", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("representative", "id").alias("representative"), F.col("elements").alias("n_shingles")
    )
