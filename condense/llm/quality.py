"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (hashed), trigrams of character classes over the whole text and a few
terms for repeated words.  How many documents have a term is counted over all documents.  A
bounded sample of labelled ones, weighted by that, gives a truncated SVD; its vectors, with their
labels, are small enough to broadcast.  Every document is projected and compared with all of them
in blocks of exact cosine products, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import parts, released
from .columns import Plain
from .sampling import per_class
from .wordhash import mix

#: Labelled documents of each class that are learned from.
SAMPLE_DOCS = 1500
DIMENSIONS = 48
NEIGHBOURS = 25
#: Weight of a neighbour: its cosine similarity to this power.
SHARPNESS = 8
THRESHOLD = 0.3
CLASSES = 12
REPEATS = 24
#: Terms that words are hashed to, and their weight beside the others.
WORDS, WORD_WEIGHT = 2048, 0.5
TERMS = CLASSES**3 + REPEATS + WORDS
#: Latent vectors are whole multiples of 1 / GRID, so that their products are exact.
GRID = 1 << 14
CHUNK = 1_000_000  # bytes of text at a time


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, 11, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[cp] = 2
        elif c.isspace():
            table[cp] = 3
    table[ord("\n")] = 4
    for i, group in enumerate((".", ",;:", "!?", "|", "-_/\\'\"()[]<>{}", "%#$&*@^~+="), 5):
        for c in group:
            table[ord(c)] = i
    return table


def terms(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Weights of each text's terms, rows of unit length before the document frequencies."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = table[code]
    doc = np.repeat(np.arange(n), size)
    out = np.zeros((n, TERMS), np.float32)
    if code.size > 2:
        tri = kind[:-2].astype(np.int64) * CLASSES**2 + kind[1:-1].astype(np.int64) * CLASSES + kind[2:]
        same = doc[:-2] == doc[2:]
        flat = np.bincount(doc[:-2][same] * CLASSES**3 + tri[same], minlength=n * CLASSES**3)
        out[:, :CLASSES**3] = np.log1p(1000.0 * flat.reshape(n, -1) / np.maximum(1, size)[:, None])
    letter = kind <= 1
    edge = letter.copy()
    edge[1:] &= ~letter[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    if first.size:
        # a word's hash sums its letters' places and codes; only equality within a document matters
        value = np.where(letter, (code | np.uint32(32)).astype(np.uint64), np.uint64(0))
        number = np.cumsum(edge) - 1
        place = np.arange(code.size) - first[np.maximum(number, 0)]
        with np.errstate(over="ignore"):
            mixed = (value * np.uint64(0x9E3779B97F4A7C15)) ^ ((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = np.where(letter, mixed * (mixed >> np.uint64(29) | np.uint64(1)), np.uint64(0))
        word = np.add.reduceat(mixed, first)
        owner = doc[first]
        words = np.bincount(owner, minlength=n)
        ratios = []
        for back in (1, 2, 3, 4, 8):
            hit = (word[back:] == word[:-back]) & (owner[back:] == owner[:-back])
            ratios.append(np.bincount(owner[back:][hit], minlength=n) / np.maximum(1, words))
        order = np.lexsort((word, owner))
        w, o = word[order], owner[order]
        fresh = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])]
        ratios.append(1 - np.bincount(o[fresh], minlength=n) / np.maximum(1, words))
        for i, r in enumerate(ratios):  # each ratio lights one of four terms
            level = np.digitize(r, (0.02, 0.1, 0.3, 0.6))
            lit = np.flatnonzero(level)
            out[lit, CLASSES**3 + 4 * i + level[lit] - 1] = 6.0
        place = owner * WORDS + (mix(word) >> np.uint64(32)).astype(np.int64) % WORDS
        flat = np.bincount(place, minlength=n * WORDS).reshape(n, -1)
        out[:, CLASSES**3 + REPEATS:] = WORD_WEIGHT * np.log1p(1000.0 * flat / np.maximum(1, words)[:, None])
    return out


def frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many of all documents have each term, and how many documents there are, as the last value.
    Tasks add up their own rows; what reaches the driver has ``TERMS`` + 1 rows at most."""
    table = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for own in parts(batch, 0, CHUNK, 1000):
                total[:-1] += (terms([t or "" for t in own.column(0).to_pylist()], table) > 0).sum(axis=0)
                total[-1] += own.num_rows
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: released(run(b)), "term int, n bigint")
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def train(labelled: DataFrame, docs: DataFrame | None = None, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> dict:
    """Learn from rows with a label of 0 or 1, about ``SAMPLE_DOCS`` of each, and from the terms of all
    ``docs`` (by default, those rows).  The driver gathers the sample's term weights: at most
    ``2 * SAMPLE_DOCS`` rows of ``TERMS`` halves.  Rows that repeat count each; their order does not matter."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    sample = per_class(rows, "label", id_col, SAMPLE_DOCS)
    table = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in parts(batch, 1, CHUNK, 1000):
                x = terms(own.column(1).to_pylist(), table).astype("<f2")
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    kind = sample.schema[id_col].dataType.simpleString()
    got = sorted(sample.select(id_col, "text", "label").mapInArrow(run, f"id {kind}, label int, x binary").collect(), key=lambda r: (r.id is None, r.id, r.label, r.x))
    if not got:
        return {"table": table, "labels": np.zeros(0)}
    x = np.stack([np.frombuffer(r.x, "<f2") for r in got]).astype(np.float32)
    labels = np.asarray([r.label for r in got], float)
    count = frequencies(docs if docs is not None else labelled, text_col)
    idf = np.log((1 + count[-1]) / (1 + count[:-1])).astype(np.float32) + 1
    x = _unit(x * idf)
    mean = x.mean(axis=0)
    project = _right_vectors(x - mean, min(DIMENSIONS, len(x)))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    return {"table": table, "idf": idf, "mean": mean, "project": project, "vectors": _grid((x - mean) @ project), "labels": labels, "weight": weight / weight.max()}


def _right_vectors(x: np.ndarray, n: int) -> np.ndarray:
    """The first right singular vectors of ``x`` as columns, by subspace iteration."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(x.shape[1], n + 16))).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ vt.T)[:, :n]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]


def _grid(x: np.ndarray) -> np.ndarray:
    return np.rint(_unit(x.astype(np.float64)) * GRID)


def latent(texts: list[str], model: dict) -> np.ndarray:
    """Latent vectors, as whole numbers."""
    x = _unit(terms(texts, model["table"]).astype(np.float64) * model["idf"]) - model["mean"]
    return _grid(x @ model["project"].astype(np.float64))


def vote(texts: list[str], model: dict) -> np.ndarray:
    """Score of each text: the similarity-weighted share of label 1 among its neighbours.  Of labelled
    vectors that are equally near, those of smaller ids (which come first) are taken."""
    labels = model["labels"]
    n = labels.size
    if not n:
        return np.full(len(texts), 0.5)
    product = (latent(texts, model) @ model["vectors"].T).astype(np.int64)  # exact: below 2**53
    k = min(NEIGHBOURS, n)
    near = np.sort(np.argpartition(np.arange(n) - product * n, k - 1, axis=1)[:, :k], axis=1)
    cosine = np.take_along_axis(product, near, axis=1) / GRID**2
    w = np.maximum(0, cosine) ** SHARPNESS * model["weight"][near] + 1e-12
    return np.clip((w * labels[near]).sum(axis=1) / w.sum(axis=1), 0, 1)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``quality_score double`` (0 to 1, higher: label 1 likelier) to all rows.

    A null text counts as empty and gets the score of an empty text's neighbours; without any
    labelled document every score is 0.5.  Equal texts, and rows that repeat, get equal scores; an
    empty table gives no rows.  A column named ``quality_score`` is replaced; all others, whatever
    their names, stay.
    """
    plain = Plain(docs)
    text = plain.at(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCS and TERMS
    schema = T.StructType(list(plain.df.schema.fields)).add("quality_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for own in parts(batch, at, CHUNK, 1000):
                scores = vote([t or "" for t in own.column(at).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "quality_score"])

    out = plain.df.mapInArrow(lambda b: released(run(b)), schema)
    return plain.restored(out, added={"quality_score": F.col("quality_score")})
