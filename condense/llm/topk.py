"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in buckets by length, longest first.  Every block of queries meets the bucket of the
longest vectors, which gives each query a k-th best score.  Over a query's length that is the least
length of a vector that can still matter, so a block is joined only with the runs of buckets that
reach it; no other bucket is sent.  There the score so far gives a local cosine threshold: beyond
1 a bucket is skipped; if it is high, candidates are pruned by the range that it leaves to the
query's largest coordinates; else the bucket is taken whole.  What is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import stored

BUCKET = 4096
QUERIES = 1024
#: Blocks of queries that share a copy of their longest bucket.
FIRST_BLOCKS = 4
#: Buckets that one task takes a block of queries through.
RUN = 8
#: Local cosine threshold from which coordinates are used, and how many.
NARROW, FOCUS = 0.9, 3
_EXACT = 2.0**53


def quantised(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as doubles that hold whole numbers; null for vectors that
    take no part: null ones and those with a component that is null or not finite.  A component that
    is beyond all doubles once it is multiplied is an error."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def whole(v: Column) -> Column:
        v = v * factor
        beyond = F.raise_error(F.lit("a component is too large to be multiplied")).cast("double")
        return F.when(F.abs(v) < F.lit(2.0**53), F.floor(v).cast("double")).when(F.abs(v) < F.lit(float("inf")), v).otherwise(beyond)

    return F.when(fine, F.transform(x, whole))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one dimension and similar length: ``block, dim, longest,
    n, ids binary, matrix binary``.  Range partitioning by length deals the vectors out."""
    total = rows.count()
    length2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("length", F.sqrt(length2))
    dealt = rows.repartitionByRange(max(1, -(-total // size)), F.col("dim"), F.col("length").desc(), F.col("vec_id")).sortWithinPartitions(
        "dim", F.col("length").desc(), "vec_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block():
            held.sort(key=lambda r: r[0])
            m = _small(np.asarray([r[1] for r in held]).reshape(len(held), -1))
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([m.shape[1]], pa.int32()), "longest": pa.array([max(r[2] for r in held)], pa.float64()), "n": pa.array([len(held)], pa.int32()),
                "ids": pa.array([np.asarray([r[0] for r in held], "<i8").tobytes()], pa.binary()), "matrix": pa.array([m.tobytes()], pa.binary()),
                "kind": pa.array([m.dtype.str], pa.string()),
            })

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vector", "length")), strict=True):
                if held and (len(held) == 2 * size or len(held[0][1]) != len(row[1])):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    packed = dealt.select("vec_id", "vector", "length").mapInArrow(run, "dim int, longest double, n int, ids binary, matrix binary, kind string")
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _small(m: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest integers that hold them, or as doubles beyond those."""
    most = max(-float(m.min(initial=0)), float(m.max(initial=0)))
    return m.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8" if most < 2**63 else "<f8")


def _matrix(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1)


def _whole(m: np.ndarray) -> np.ndarray:
    """As Python's integers."""
    return np.asarray([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)


def _products(q: np.ndarray, p: np.ndarray, valid: np.ndarray | bool = True) -> np.ndarray:
    """Exact integer products; through doubles where those hold every sum, through Python's integers where a
    long might not.  A ``valid`` product that is no long is an error."""
    most = max(1, q.shape[1])
    for m in (q, p):
        most *= max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if most < _EXACT:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ p.T.astype(np.int64)
    s = np.where(valid, _whole(q) @ _whole(p).T, 0) if q.size and p.size else np.zeros((len(q), len(p)), np.int64)
    if s.size and (s.max() >= 2**63 or s.min() < -(2**63)):
        raise OverflowError("an inner product is no 64-bit integer")
    return s.astype(np.int64)


def _choose(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best valid scores; of equal ones the first columns."""
    low = np.iinfo(np.int64).min
    s = np.where(valid, scores, low)
    if s.shape[1] > k:
        kth = np.partition(s, -k, axis=1)[:, -k][:, None]
        tie = s == kth
        left = k - (s > kth).sum(axis=1, keepdims=True)
        pick = (s > kth) | (tie & (np.cumsum(tie, axis=1) <= left))
    else:
        pick = np.ones(s.shape, bool)
    return np.nonzero(pick & valid)


class _Best:
    """The k best of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.there = np.zeros((n, 0), bool)

    def least(self) -> np.ndarray:
        """The k-th score, minus infinity where there are fewer."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -np.inf)
        return np.where(self.there[:, -1], self.score[:, -1].astype(float), -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not rows.size:
            return
        order = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(rows.size) - np.repeat(first, np.diff(np.r_[first, rows.size]))
        fine = place < self.k
        rows, score, ids, place = rows[fine], score[fine], ids[fine], place[fine]
        new = [np.zeros((len(self.score), self.k), t) for t in (np.int64, np.int64, bool)]
        new[0][rows, place], new[1][rows, place], new[2][rows, place] = score, ids, True
        s, i, t = (np.concatenate((a, b), axis=1) for a, b in zip((self.score, self.id, self.there), new, strict=True))
        order = np.lexsort((i, -s, ~t), axis=1)[:, :self.k]
        self.score, self.id, self.there = (np.take_along_axis(x, order, axis=1) for x in (s, i, t))


def search(q: np.ndarray, q_ids: np.ndarray, buckets: Iterator[tuple[np.ndarray, np.ndarray, float]], k: int, known: np.ndarray | None = None) -> tuple[_Best, dict]:
    """Take a block of queries through buckets ``(matrix, ids, longest)``, longest first.  ``known``: scores
    that ``k`` other candidates of each query reach."""
    best, done = _Best(len(q), k), {"skipped": 0, "coordinates": 0, "whole": 0}
    q_len = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    focus = np.argsort(-np.abs(q.astype(float)), axis=1, kind="stable")[:, :FOCUS]
    for p, ids, longest in buckets:
        least = best.least() if known is None else np.maximum(known, best.least())
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = q_len * longest
            cosine = np.where(bound > 0, least / bound, np.where(least > 0, np.inf, -np.inf))
        out = cosine > 1 + 1e-9
        done["skipped"] += int(out.sum())
        narrow = np.flatnonzero((cosine >= NARROW) & ~out)
        whole = np.flatnonzero(~out & ~(cosine >= NARROW))
        done["coordinates"] += narrow.size
        done["whole"] += whole.size
        if narrow.size:
            p_len = np.sqrt((p.astype(float) ** 2).sum(axis=1))
            unit = p / np.maximum(p_len, 1e-300)[:, None]
        for i in narrow.tolist():
            # the angle to the query is at most ``wide``, so that to an axis is within ``wide`` of the query's own
            wide = np.arccos(min(1.0, cosine[i])) + 1e-6
            near = np.ones(len(p), bool)
            for f in focus[i].tolist():
                own = np.arccos(np.clip(q[i, f] / q_len[i], -1, 1))
                near &= (unit[:, f] <= np.cos(max(0.0, own - wide)) + 1e-9) & (unit[:, f] >= np.cos(min(np.pi, own + wide)) - 1e-9)
            near &= ids != q_ids[i]
            found = np.flatnonzero(near)
            s = _products(q[i:i + 1], p[found])[0]
            fine = s >= least[i]
            best.add(np.full(int(fine.sum()), i), s[fine], ids[found[fine]])
        if whole.size:
            valid = ids[None, :] != q_ids[whole, None]
            s = _products(q[whole], p, valid)
            rows, cols = _choose(s, valid & (s >= least[whole, None]), k)
            best.add(whole[rows], s[rows, cols], ids[cols])
    return best, done


_FOUND = "q_block bigint, row bigint, query_id bigint, vec_id bigint, score bigint"


def _found(block: int, q_ids: np.ndarray, best: _Best) -> pd.DataFrame:
    rows, cols = np.nonzero(best.there)
    return pd.DataFrame({"q_block": block, "row": rows, "query_id": q_ids[rows], "vec_id": best.id[rows, cols], "score": best.score[rows, cols]}).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` highest integer inner products of each query among all other rows.

    ``vectors`` has ``vec_id, vector`` (an array of longs, or of doubles that hold whole numbers); rows with a
    null in either take no part, nor do candidates of another dimension than the query's.  A
    query's own row is told by its id, so rows that repeat the id are no candidates; other
    repeated rows each take a rank.  Ties go to the smaller id; fewer than ``k`` candidates give
    fewer rows, an empty table none.  Products are exact; one that is no 64-bit integer is an error.
    Other columns are ignored.  Returns ``query_id, rank, vec_id, score``.
    """
    vectors = vectors.select("vec_id", "vector", is_query.alias("is_query")).where("vec_id is not null and vector is not null")
    buckets = _packed(vectors, BUCKET, "topk-buckets")
    blocks = _packed(vectors.where("is_query"), QUERIES, "topk-queries")
    order = W.partitionBy("dim").orderBy(F.desc("longest"), "block")
    place = F.row_number().over(order) - 1  # over block descriptions: one row for BUCKET vectors
    places = stored(buckets.select("block", "dim", "longest").withColumn("place", place), "topk-places").hint("merge")
    asked = blocks.select(F.col("block").alias("q_block"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("kind").alias("q_kind"))

    # each block with the longest bucket of its dimension
    # of which every few blocks get a copy, so that the blocks of a dimension do not meet in one task
    copies = max(1, -(-blocks.count() // FIRST_BLOCKS))
    longest = buckets.hint("merge").join(places.where("place = 0").select("block"), "block").drop("block")
    longest = longest.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    mine = asked.withColumn("copy", F.pmod(F.xxhash64("q_block"), F.lit(copies)).cast("int"))
    pairs = mine.hint("merge").join(longest, ["dim", "copy"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (r for batch in batches for r in batch.itertuples()):
            q, q_ids = _matrix(b.q_matrix, b.q_kind, b.q_n), np.frombuffer(b.q_ids, "<i8")
            best, _ = search(q, q_ids, iter([(_matrix(b.matrix, b.kind, b.n), np.frombuffer(b.ids, "<i8"), b.longest)]), k)
            least, q_len = best.least(), np.sqrt((q.astype(float) ** 2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(least > 0, least / q_len, 0.0)  # shorter vectors cannot matter
            yield pd.DataFrame({
                "q_block": [b.q_block], "least": [least.astype("<f8").tobytes()], "reach": [float(reach.min(initial=np.inf)) * (1 - 1e-9)],
                "ids": [best.id.astype("<i8").tobytes()], "scores": [best.score.astype("<i8").tobytes()], "there": [best.there.tobytes()], "q_ids": [b.q_ids],
            })

    begun = stored(pairs.mapInPandas(first, "q_block bigint, least binary, reach double, ids binary, scores binary, there binary, q_ids binary"), "topk-first")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (r for batch in batches for r in batch.itertuples()):
            q_ids, best = np.frombuffer(b.q_ids, "<i8"), _Best(0, k)
            best.id, best.score, best.there = (np.frombuffer(x, t).reshape(len(q_ids), -1) for x, t in ((b.ids, "<i8"), (b.scores, "<i8"), (b.there, bool)))
            yield _found(b.q_block, q_ids, best)

    # the other buckets in runs of neighbours, for the blocks that they reach
    run = F.floor((F.col("place") - 1) / RUN).cast("bigint")
    rest = places.where("place > 0").withColumn("run", run)
    runs = rest.groupBy("dim", "run").agg(F.max("longest").alias("most"))
    waiting = asked.hint("merge").join(begun.select("q_block", "least", "reach"), "q_block")
    met = waiting.select("q_block", "dim", "reach").hint("merge").join(runs, "dim").where(F.col("most") >= F.col("reach")).select("q_block", "dim", "run")
    met = stored(met, "topk-pairs")
    left = waiting.drop("dim", "reach").hint("merge").join(met.drop("dim"), "q_block").groupBy("q_block", "run")
    sent = buckets.drop("dim").hint("merge").join(rest.select("block", "dim", "run"), "block")
    right = sent.hint("merge").join(met.select(F.col("q_block").alias("r_block"), "dim", "run"), ["dim", "run"]).groupBy("r_block", "run")

    def others(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return _found(0, np.zeros(0, np.int64), _Best(0, k))
        m = mine.iloc[0]
        q, q_ids = _matrix(m.q_matrix, m.q_kind, m.q_n), np.frombuffer(m.q_ids, "<i8")
        each = theirs.sort_values(["longest", "block"], ascending=[False, True])
        best, _ = search(q, q_ids, ((_matrix(b.matrix, b.kind, b.n), np.frombuffer(b.ids, "<i8"), b.longest) for b in each.itertuples()), k, np.frombuffer(m.least, "<f8"))
        return _found(m.q_block, q_ids, best)

    found = begun.mapInPandas(listed, _FOUND).unionByName(left.cogroup(right).applyInPandas(others, _FOUND))
    rank = F.row_number().over(W.partitionBy("q_block", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
