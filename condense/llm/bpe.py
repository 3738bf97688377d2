"""BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

Texts are cut at ASCII white space.  No token of the supported tokenizers spans white space
(checked by :func:`splits_at_white_space`), so each different word of a block of texts is encoded
once: from the words that this worker has met, else from the memory-mapped lexicon, else by exact
merges.  Words, ids and texts stay in Arrow and numpy arrays throughout.
"""

from __future__ import annotations

import functools
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .batches import byte_rows, parts, raw_bytes, released, runs
from .merges import Merger
from ..sources.scratch import drop_stored, put_file, shared_dir, stored

#: Words compiled into the lexicon; bounds what the driver gathers.
LEXICON_WORDS = 1 << 16
#: Words that a Python worker remembers before it starts anew.
CACHE_WORDS = 400_000
#: Longest word (bytes) that is remembered or counted; longer ones are encoded each time.
CACHE_BYTES = 64
#: Text that is encoded at a time, and texts at most.
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 4000
WHITE = r"[\x09-\x0D\x20]+"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def splits_at_white_space(path: str) -> bool:
    """Whether the tokenizer drops white space before it merges, as word-wise encoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = json.dumps(spec.get("pre_tokenizer"))
    return '"behavior": "Removed"' in pre and r"[^\\s" in pre and '"add_prefix_space": true' not in pre


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binaries) and how many each text has."""
    data, size = raw_bytes(texts)
    if not data.size:
        return pa.array([], pa.binary()), np.zeros(size.size, np.int64)
    inner = ~_IS_WHITE[data]
    edge = np.zeros(data.size, bool)  # a text's first byte begins a word
    start = np.cumsum(size) - size
    edge[start[size > 0]] = True
    first = inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:]
    at = np.flatnonzero(first)
    before = np.concatenate(([0], np.cumsum(inner)))
    length = np.diff(np.append(before[at], before[-1]))
    counts = np.diff(np.append(np.searchsorted(at, start), at.size))
    return byte_rows(data[inner], length), counts


class Splitter:
    """Cuts words as the supported tokenizers do, for words of printable ASCII and Latin letters
    (which NFC leaves alone)."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTER, DIGIT, MARK, END, OTHER = range(5)

    def __init__(self) -> None:
        kinds = np.full(0x251, self.OTHER, "u1")
        for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)):
            if max(map(ord, chr(c).lower())) < 0x250:  # few letters leave this range in lower case
                kinds[c] = {"L": self.LETTER, "N": self.DIGIT}.get(unicodedata.category(chr(c))[0], self.MARK)
        kinds[0x0A] = self.END
        self.kinds = kinds

    def kind(self, code: np.ndarray) -> np.ndarray:
        return self.kinds[np.minimum(code, 0x250)]

    def pieces(self, text: str) -> tuple[pa.Array, np.ndarray]:
        """Pieces of a lower-case text of words that each end with a line feed, and pieces a word."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kind(code)
        cut = np.ones(code.size, bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        quote = np.flatnonzero(code == ord("'"))
        quote = quote[(quote == 0) | (kind[quote - 1] != self.MARK)]  # else it is within a run of marks
        if quote.size:
            padded = np.append(code, [10, 10]).astype("<u4")
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(quote.size, bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for at, n in ((quote[short], 2), (quote[long], 3)):
                cut[at + n] = True
                for i in range(1, n):
                    cut[at + i] = False
        end = kind == self.END
        cut[end] = True
        width = np.where(code < 0x80, 1, 2)
        width[end] = 0
        first = np.flatnonzero(cut)
        size = np.add.reduceat(width, first) if first.size else np.zeros(0, np.int64)
        ends = end[first]
        counts = np.diff(np.concatenate(([0], np.cumsum(~ends)[ends])))
        data = np.frombuffer(text.encode(), "u1")
        return byte_rows(data[data != 10], size[~ends]), counts


class Encoder:
    """Word-wise encoder of one Python worker."""

    def __init__(self, path: str, lexicon: lx.Lexicon | None = None):
        self.path, self.lexicon = path, lexicon
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        own = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        own = own and cuts[0]["pattern"].get("Regex") == Splitter.PATTERN
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.splitter = Splitter() if own else None
        self.merger = Merger(path) if own else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.size, self.pool = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for s in range(0, len(words), 4096) for e in tokenizer(self.path).encode_batch_fast(words[s:s + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for own in ids for x in own), "<u4", int(size.sum())), size

    def exact(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row by exact merges, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        data, _ = raw_bytes(pc.binary_join_element_wise(words, pa.scalar(b""), pa.scalar(b"\n")))
        text = data.tobytes().decode("utf-8", "replace")
        if self.splitter is None:
            return self._by_library(text.split("\n")[:-1])
        odd = self.splitter.kind(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        slow = np.zeros(len(words), bool)
        if (odd == Splitter.OTHER).any() or any(s in text for s in self.special):
            word = np.cumsum(odd == Splitter.END)
            slow[word[odd == Splitter.OTHER]] = True
            for s in self.special:
                slow |= pc.match_substring(words.cast(pa.binary()), s).to_numpy(zero_copy_only=False)
        if not slow.any():
            return self._merged(text)
        own = text.split("\n")[:-1]
        quick = [w for w, x in zip(own, slow.tolist(), strict=True) if not x]
        a, n_a = self._merged("".join(f"{w}\n" for w in quick))
        b, n_b = self._by_library([w for w, x in zip(own, slow.tolist(), strict=True) if x])
        size, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[~slow], size[slow] = n_a, n_b
        first[~slow], first[slow] = np.cumsum(n_a) - n_a, a.size + np.cumsum(n_b) - n_b
        return np.concatenate((a, b))[runs(first, size)], size

    def _merged(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.splitter.pieces(text.lower())
        coded = pieces.dictionary_encode()
        data, size = raw_bytes(coded.dictionary)
        start = np.cumsum(size) - size
        short = np.flatnonzero(size <= Merger.LONGEST)
        long = np.flatnonzero(size > Merger.LONGEST)
        a, n_a = self.merger.merge(data, start[short], size[short])
        b, n_b = self._by_library([data[start[i]:start[i] + size[i]].tobytes().decode() for i in long.tolist()])
        n, first = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
        n[short], n[long] = n_a, n_b
        first[short], first[long] = np.cumsum(n_a) - n_a, a.size + np.cumsum(n_b) - n_b
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = np.concatenate((a, b))[runs(first[at], n[at])]
        ends = np.concatenate(([0], np.cumsum(n[at])))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)

    def _resolved(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are new here: from the lexicon, else by exact merges."""
        if self.lexicon is None:
            return self.exact(words)
        first, size = self.lexicon.lookup(*raw_bytes(words))
        missing = np.flatnonzero(first < 0)
        a = self.lexicon.ids
        b, n_b = self.exact(words.take(pa.array(missing)))
        size[missing], first[missing] = n_b, np.cumsum(n_b) - n_b
        from_b = np.zeros(size.size, bool)
        from_b[missing] = True
        out = np.empty(int(size.sum()), "<u4")
        is_b = np.repeat(from_b, size)
        at = runs(first, size)
        out[is_b], out[~is_b] = b[at[is_b]], a[at[~is_b]]
        return out, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts (binaries) in a row, and how many each text has."""
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        different = coded.dictionary
        if len(self.known) + len(different) > CACHE_WORDS:
            self._forget()
        place = pc.index_in(different, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        first, size, pool = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64), self.pool
        old = place >= 0
        first[old], size[old] = self.first[place[old]], self.size[place[old]]
        if new.size:
            own = different.take(pa.array(new))
            ids, n = self._resolved(own)
            first[new], size[new] = pool.size + np.cumsum(n) - n, n
            pool = np.concatenate((pool, ids))
            short = pc.binary_length(own).to_numpy() <= CACHE_BYTES
            if short.all() and len(self.known) + new.size <= CACHE_WORDS:
                self.pool, keep = pool, new
            else:  # what is too long, or would not fit, is used once
                keep = new[short][:max(0, CACHE_WORDS - len(self.known))]
                self.pool = np.concatenate((self.pool, pool[runs(first[keep], size[keep])]))
            self.first = np.concatenate((self.first, self.pool.size - int(size[keep].sum()) + np.cumsum(size[keep]) - size[keep]))
            self.size = np.concatenate((self.size, size[keep]))
            self.known = pa.concat_arrays([self.known, different.take(pa.array(keep))])
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ids = pool[runs(first[at], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)


@functools.lru_cache(maxsize=4)
def encoder(path: str, lexicon_file: str | None = None) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    return Encoder(path, lx.Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array | None:
    """Each token and a space, where the tokenizer's file names no decoder."""
    with open(path, encoding="utf-8") as f:
        if json.load(f).get("decoder") is not None:
            return None
    t = tokenizer(path)
    n = 1 + max(t.get_vocab(with_added_tokens=True).values())
    return pa.array([(t.id_to_token(i) or "").encode() + b" " for i in range(n)], pa.binary())


def decode(path: str, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The library's ``decode(ids, skip_special_tokens=False)`` of runs of ids: without a decoder in
    the tokenizer's file that is its tokens with a space between them."""
    table = _pieces(path)
    ends = np.concatenate(([0], np.cumsum(counts)))
    if table is None:
        own = [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.array([tokenizer(path).decode(x, skip_special_tokens=False).encode() for x in own], pa.binary())
    data, size = raw_bytes(table.take(pa.array(ids)))
    at = np.concatenate(([0], np.cumsum(size)))[ends]
    return pc.binary_slice(byte_rows(data, np.diff(at)), 0, -1)


def utf8(column: str = "text"):
    """A text column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count the words of all documents, compile the most frequent, at most ``size``, with their ids
    and give the file to every executor.  Returns the file's name for :func:`encoder`."""
    spark = docs.sparkSession
    words = (
        docs.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), WHITE)).alias("word"))
        .where((F.col("word") != "") & (F.octet_length("word") <= CACHE_BYTES))
        .groupBy("word").count()
        .where("count > 1")
        .select(F.col("word").cast("binary").alias("word"), F.floor(F.log2("count") * 16).cast("int").alias("step"))
    )
    words = stored(words, "bpe-words")
    # how frequent a word must be is read off a histogram of some hundred steps, so that no
    # partition sends more words than are taken
    least, n = 1 << 30, 0
    for r in sorted(words.groupBy("step").count().collect(), reverse=True):
        n += r["count"]
        if n > size:
            break
        least = r.step
    top = [bytes(r.word) for r in words.where(F.col("step") >= least).select("word").collect()]  # at most ``size`` short words
    drop_stored(words)
    ids, counts = Encoder(path).exact(pa.array(top, pa.binary()))
    ends = np.cumsum(counts)
    entries = {w: ids[e - c:e].tolist() for w, c, e in zip(top, counts.tolist(), ends.tolist(), strict=True)}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as own:  # only on its way to the shared folder
        lx.build(entries, f"{own}/{name}")
        url = put_file(spark, f"{own}/{name}", f"{shared_dir(spark, 'lexicon')}/{name}")
    spark.sparkContext.addFile(url)  # executors fetch it from the shared folder, not from the driver
    return name


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns ``id_col, ids binary`` (little-endian 32-bit) and ``decoded binary`` (UTF-8).  A null
    or empty text has no ids and decodes to the empty text; repeated rows each give a row; other
    columns are ignored, whatever their names; an empty table gives no rows.  One pass without a
    shuffle after the word count.
    """
    if not splits_at_white_space(path):
        raise ValueError("tokens of this tokenizer can span white space")
    name = compile_lexicon(docs, path, text_col, lexicon_words) if lexicon_words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name)
        for batch in (p for b in batches for p in parts(b, 1, BLOCK_BYTES, BLOCK_TEXTS)):
            ids, counts = enc.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_rows(ids.view("u1"), 4 * counts), decode(path, ids, counts)], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
        .mapInArrow(lambda b: released(run(b)), f"id {kind}, ids binary, decoded binary")
        .withColumnRenamed("id", id_col)
    )


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of :func:`encode_decode`'s rows."""
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
