"""Ranked retrieval from postings with block maxima.

Documents are dealt to blocks, and a term's postings of one block are one row with the block's largest
impact beside them.  A query reads that column first: the sum of its terms' maxima bounds every score in a
block.  The blocks of the highest bounds are scored, their k-th best score is a threshold, and of
all other blocks only those whose bound reaches it are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Occurrences of a term beyond which a document is no better.
MOST_TF = 3
#: Documents of a block, about.
BLOCK_DOCS = 64
_SLACK = 1e-9


def block_postings(docs: DataFrame, blocks: int, id_col: str = "hash", text_col: str = "content") -> DataFrame:
    """``term, block, most, n, ids, tfs``: of each word and block of documents, the largest number of occurrences
    (at most ``MOST_TF``) and the documents with theirs.  Words are folded and cut at white space.

    Texts are dealt out by block, so that no row of a word is shuffled, and a word that every document has is as many
    groups as there are blocks, none of which has more documents than its block."""
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")).repartition("block")
    words = dealt.select("block", "id", F.explode(text.path_tokens("text")).alias("term"))
    own = words.groupBy("block", "id", "term").agg(F.count("*").alias("n"))
    rows = own.select("term", "block", "id", F.least(F.lit(MOST_TF), F.col("n")).cast("int").alias("tf"))
    packed = rows.groupBy("term", "block").agg(F.max("tf").alias("most"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("e"))
    return packed.select("term", "block", "most", "n", F.col("e.id").alias("ids"), F.col("e.tf").alias("tfs"))


def weights(index: DataFrame, terms: list[str], n_docs: int) -> dict[str, float]:
    """Inverse document frequency of each of a query's terms; 0 for one that no document has."""
    found = index.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df")).collect()  # a row a term of the query
    df = {r.term: r.df for r in found}
    return {t: math.log1p((n_docs - df[t] + 0.5) / (df[t] + 0.5)) if t in df else 0.0 for t in terms}


def _weight(of: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col("term") == t, F.lit(w)) for t, w in of.items()))


def bounds(index: DataFrame, of: dict[str, float]) -> DataFrame:
    """``block, bound, n``: the most that a document of each block can score, and how many it has at most."""
    own = index.where(F.col("term").isin(list(of))).select("term", "block", "most", "n")
    return own.groupBy("block").agg(F.sum(F.col("most") * _weight(of)).alias("bound"), F.sum("n").alias("n"))


def scored(index: DataFrame, of: dict[str, float], blocks: DataFrame) -> DataFrame:
    """``id, score`` of all documents in ``blocks`` (``block``) with one of the terms."""
    own = index.where(F.col("term").isin(list(of))).join(blocks.select("block"), "block", "left_semi")
    each = own.select(_weight(of).alias("w"), F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return each.groupBy(F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("p.tfs") * F.col("w")), 9).alias("score"))


def reaching(index: DataFrame, of: dict[str, float], k: int) -> DataFrame:
    """``block, bound`` of the blocks that can hold one of the ``k`` best documents."""
    every = bounds(index, of)
    # each has a document with the largest impact of some term, so ``k`` blocks of the highest bounds make a high threshold
    seeds = every.orderBy(F.desc("bound"), "block").limit(k)
    best = scored(index, of, seeds).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
    return every.where(F.col("bound") + _SLACK >= (best.least if best.n == k else 0.0)).select("block", "bound")


def top_k(index: DataFrame, terms: list[str], k: int, n_docs: int) -> DataFrame:
    """``id, score`` of the ``k`` documents with the largest sums of capped occurrences times inverse document
    frequency, equal ones by ``id``; documents with none of the terms are not among them.  The same as
    scoring every posting of the terms, but only blocks that can reach the k-th score are read."""
    of = weights(index, terms, n_docs)
    return scored(index, of, reaching(index, of, k)).orderBy(F.desc("score"), "id").limit(k)
