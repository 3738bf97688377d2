"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``.  All but the last keep
the columns of ``documents``, and further columns of any name, with their types and values.

In every stage an empty table gives an empty one, rows that repeat id and text fare alike (of them one
is left after near_duplicates), and a null id comes before all others and is no other document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condense.llm import langid, lines, minhash, packing, substrings
from condense.llm.columns import Plain
from condense.llm.queries import table, word_bpe
from condense.sources.scratch import drop_path, scope, shared_dir

#: Most bits a symbol for a text in one of the learned languages; a letter that no sample has costs
#: about 17, so texts mostly in another script are beyond it, and short or noisy ones are not.
MOST_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in the languages of the labelled ones; the rest (null texts, no letters, another
    script) goes."""
    plain = Plain(docs)
    text = plain.at("text")
    predicted = langid.predict(plain.df, langid.train(plain.df, text, plain.at("lang")), text)
    return plain.restored(predicted.where(langid.kept(F.col("lang_pred"), F.col("bits"), MOST_BITS)))


def _shortened(plain: Plain, cut: DataFrame, text) -> DataFrame:
    """``cut`` with the new text and its length, in the columns that came."""
    changed = {plain.at("text"): text}
    if "n_chars" in plain.names:
        n_chars = plain.at("n_chars")
        changed[n_chars] = F.length(text).cast(plain.df.schema[n_chars].dataType)
    return plain.restored(cut, changed)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines, those of one or two lines from ``LEAST_WORDS`` words on; a
    document that loses all its lines is a copy and goes.  A null or empty text stays as it is."""
    plain = Plain(docs)
    cut = lines.remove_repeated_lines(plain.df, plain.at("doc_id"), plain.at("text"), least_words=lines.LEAST_WORDS)
    return _shortened(plain, cut.where("n_removed = 0 or n_removed < n_lines"), F.col(plain.at("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.  Texts without words,
    and documents without an id, are nobody's duplicates."""
    plain = Plain(docs)
    key, text = plain.at("doc_id"), plain.at("text")
    groups = minhash.near_duplicates(plain.df, key, text)
    others = groups.where(F.col("class_id") != F.col(key)).select(F.col(key).alias("other")).distinct()
    left = plain.df.hint("merge").join(others, F.col(key) == F.col("other"), "left_anti")
    return plain.restored(left.withColumn("hash", F.xxhash64(text)).dropDuplicates([key, "hash"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete passages that occur earlier; a document that loses all its words goes.  Texts
    without such passages, null and empty ones among them, stay as they are."""
    plain = Plain(docs)
    text = plain.at("text")
    cut = substrings.remove_repeats(plain.df, plain.at("doc_id"), text).where("n_removed = 0 or n_removed < n_words")
    return _shortened(plain, cut, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row per piece as :func:`condense.llm.packing.harmonic_pack` gives them; a null
    or empty text is its end id alone, and repeated rows are packed each."""
    return packing.harmonic_pack(docs.select("doc_id", "text"), word_bpe())


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: No stage but line dedup can be told in SQL; tests hold all five against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``.  What a stage has written in between goes when its result
    is written, and that goes when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
