"""Language identification by cross-parsing.

For each language a suffix automaton holds all factors of a sample of its labelled texts, taken
whole.  A document is parsed greedily against each automaton: every phrase is the longest match
from where the last one ended.  Phrases times the bits that name a phrase, over the document's
length, estimate the cross-entropy; the language that needs fewest normalised phrases wins.

Letters beyond the commonest are written as several symbols, so no script is too large.  Documents
are cut into blocks of ``BLOCK`` symbols that are parsed side by side; then each block is parsed
again from the state in which the one before it ended, until it meets its first parse.  As the
state decides all that follows, the counts are those of one parse from end to end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import parts, released
from .columns import Plain

#: Labelled rows a language that are looked at first; their distinct texts are learned whole, in the
#: order of a hash, until they hold ``SAMPLE_SYMBOLS`` symbols.
SAMPLE_DOCS = 150
SAMPLE_SYMBOLS = 120_000
#: Where those are too few, how many times as many rows are looked at next, and how often.
MORE, ROUNDS = 8, 2
#: Labelled rows with longer texts (bytes) are not sampled.
SAMPLE_BYTES = 1 << 20
PLACES = 1 << 30
#: Words of a passage that is left out if an earlier sample text has it.
WINDOW = 8
#: Symbols of all languages together; with many languages each has a smaller sample.
ALL_SYMBOLS = 4_000_000
ALPHABET = 64
#: Letters with a symbol of their own; the others are written with the remaining symbols as digits.
LETTERS = 46
BLOCK = 512
CHUNK = 2_000_000  # bytes of text parsed at a time
#: So many lanes or fewer are not worth arrays.
FEW = 8
NONE = "und"
_SPACE = 1


@dataclass
class Symbols:
    """How code points are written: ``place`` of each (0: a letter that no sample has, 1: no letter,
    else a letter, the commonest first) and ``digits`` of the letters that have no own symbol."""

    place: np.ndarray
    digits: int

    @property
    def width(self) -> int:
        return ALPHABET if self.digits else int(self.place.max()) + 1


def symbol_table(texts: list[str]) -> Symbols:
    seen = Counter()
    for t in texts:
        seen.update(t.lower())
    letters = sorted((c for c in seen if c.isalpha()), key=lambda c: (-seen[c], c))
    kept = {c: i + 2 for i, c in enumerate(letters)}
    place = np.full(0x110000, _SPACE, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            place[cp] = kept.get(c.lower(), 0)
    digits, base = 0, ALPHABET - 2 - LETTERS
    while len(letters) > LETTERS and base**digits < len(letters) - LETTERS:
        digits += 1
    return Symbols(place, digits)


def symbols(texts: list[str], table: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, symbols per text, letters per text.  Runs of non-letters
    count as one symbol."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = table.place[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    space = flat == _SPACE
    keep = np.ones(flat.size, bool)
    keep[1:] = ~(space[1:] & space[:-1])
    start = np.cumsum(size) - size
    keep[start[size > 0]] = True
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(start, flat.size)])
    letters = sums(~space)
    many = flat >= LETTERS + 2
    if not many.any():
        return flat[keep].astype(np.uint8), sums(keep), letters
    each = np.where(many, table.digits, 1)
    size = sums(np.where(keep, each, 0))
    flat, each = flat[keep], each[keep]
    which = np.repeat(flat, each)
    nth = np.arange(which.size) - np.repeat(np.cumsum(each) - each, each)
    base = ALPHABET - 2 - LETTERS
    digit = (which - LETTERS - 2) // base**nth % base + LETTERS + 2
    return np.where(which >= LETTERS + 2, digit, which).astype(np.uint8), size, letters


@dataclass
class Automaton:
    """A suffix automaton.  The edge of ``state`` with symbol ``c`` is at ``base[state] + c`` of ``edges``,
    if the upper half there names the state; the lower half is where it leads.  Where no longer match
    exists, a new phrase begins with the symbol and the next state is its entry in ``first``, given
    as its complement (~).  ``start`` has no edge: it stands before a text and behind a letter that
    the sample does not have."""

    edges: np.ndarray
    base: np.ndarray
    first: np.ndarray
    start: int

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        edge = self.edges.take(self.base.take(state, mode="clip") + c, mode="clip")
        return np.where(edge >> 32 == state, edge & 0xFFFFFFFF, self.first.take(c, mode="clip"))


def automaton(text: np.ndarray, width: int = ALPHABET) -> Automaton:
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    nexts.append({})  # the start of every phrase
    first = np.full(width, ~(len(nexts) - 1), np.int64)
    for c, s in nexts[0].items():
        first[c] = ~s
    # states that branch have a row of their own; those with one edge stand in the free places of the rows
    several = [s for s, own in enumerate(nexts) if len(own) > 1]
    single = [s for s, own in enumerate(nexts) if len(own) == 1]
    base = np.zeros(len(nexts), np.int64)
    base[several] = np.arange(len(several)) * width
    states = np.repeat(several, [len(nexts[s]) for s in several]).astype(np.int64)
    at = base[states] + np.fromiter((c for s in several for c in nexts[s]), np.int64, states.size)
    edges = np.full(max(width, len(several) * width) + len(single) + width, -1 << 32, np.int64)
    edges[at] = states << 32 | np.fromiter((t for s in several for t in nexts[s].values()), np.int64, states.size)
    free = np.flatnonzero(edges < 0)
    free = free[free >= width][:len(single)]
    symbol = np.fromiter((next(iter(nexts[s])) for s in single), np.int64, len(single))
    base[single] = free - symbol
    edges[free] = np.asarray(single, np.int64) << 32 | np.fromiter((next(iter(nexts[s].values())) for s in single), np.int64, len(single))
    return Automaton(edges, base, first, len(nexts) - 1)


def _agrees(machine: Automaton, state: int, codes: np.ndarray, seen: np.ndarray, at: int, step: int, size: int) -> bool:
    """Parse one block again from ``state`` up to where it agrees with its earlier parse, if it does."""
    edges, base, first = machine.edges.item, machine.base.item, machine.first.item
    for i in range(at, at + size * step, step):
        c = codes.item(i)
        edge = edges(base(state) + c)
        to = edge & 0xFFFFFFFF if edge >> 32 == state else first(c)
        state = to ^ (to >> 63)
        before = seen.item(i)
        seen[i] = to
        if state == before ^ (before >> 63):
            return True
    return False


def phrases(flat: np.ndarray, size: np.ndarray, machines: list[Automaton]) -> np.ndarray:
    """Phrases of each text (rows) against each automaton (columns)."""
    out = np.zeros((size.size, len(machines)), np.int64)
    first = np.cumsum(size) - size
    blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(size.size), blocks)
    within = np.arange(doc.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[doc] + within * BLOCK
    end = np.minimum(start + BLOCK, (first + size)[doc])
    order = np.argsort(start - end, kind="stable")
    length = (end - start)[order]
    steps, n = int(length[0]) if length.size else 0, length.size
    active = np.searchsorted(-length, -np.arange(steps), "left").tolist()  # lanes longer than each step
    # symbols of all blocks side by side, the longest first
    text = np.zeros((steps, n), np.int64)
    lane = np.empty(n, np.int64)
    lane[order] = np.arange(n)
    place = (np.arange(flat.size) - np.repeat(start, end - start)) * n + np.repeat(lane, end - start)
    text.ravel()[place] = flat
    more = np.append(within[1:] > 0, False)  # blocks that another of the same text follows
    for k, machine in enumerate(machines):
        trace = np.empty((steps, n), np.int64)  # the state after each symbol, as ~state where a phrase begins
        state = np.full(n, machine.start, np.int64)
        for j, m in enumerate(active):
            to = machine.step(state[:m], text[j, :m])
            trace[j, :m] = to
            state = to ^ (to >> 63)
        again = np.flatnonzero(within > 0)
        seen = trace.ravel()
        codes = text.ravel()
        while again.size > FEW:  # from where the block before has ended, until both parses agree
            own, at = again, lane[again]
            state = seen[(BLOCK - 1) * n + lane[own - 1]]
            state = state ^ (state >> 63)
            last = at + (end - start - 1)[own] * n
            over = []
            while own.size:
                to = machine.step(state, codes[at])
                state = to ^ (to >> 63)
                before = seen[at]
                seen[at] = to
                apart = state != before ^ (before >> 63)
                left = apart & (at < last)
                over.append(own[apart & ~left])
                own, at, state, last = own[left], at[left] + n, state[left], last[left]
            changed = np.concatenate(over)
            again = np.sort(changed[more[changed]] + 1)
        sizes = (end - start).tolist()
        for block in again.tolist():  # the few that go on for long are parsed one by one
            state = seen.item((BLOCK - 1) * n + lane[block - 1])
            while not _agrees(machine, state ^ (state >> 63), codes, seen, int(lane[block]), n, sizes[block]) and more[block]:
                state = seen.item((BLOCK - 1) * n + lane[block])
                block += 1
        begins = np.concatenate(([0], np.cumsum(seen[place] < 0)))
        out[:, k] = begins[first + size] - begins[first]
    return out


def own_words(words: list[str], seen: set[int]) -> list[str]:
    """``words`` without passages that earlier sample texts have, whose windows are in ``seen``; those of
    this text are added.  So of boilerplate and copies, in whatever language, the first stays."""
    windows = [hash(tuple(words[i:i + WINDOW])) for i in range(len(words) - WINDOW + 1)]
    drop = [False] * len(words)
    for i, w in enumerate(windows):
        if w in seen:
            drop[i:i + WINDOW] = [True] * WINDOW
    seen.update(windows)
    return [w for w, d in zip(words, drop, strict=True) if not d]


def sampled_texts(rows: DataFrame, each: Callable[[int], int]) -> dict[str, list[str]]:
    """From ``text, lang``: what is learned of each language, as whole texts without repeated passages.

    Distinct texts are taken in the order of a hash, out of about ``SAMPLE_DOCS`` a language, until the
    language has ``each(languages)`` letters and gaps.  One that has less then gets ``MORE`` times as
    many, up to ``ROUNDS`` times.
    """
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).collect()}
    least = each(len(counts))
    texts: dict[str, list[str]] = {l: [] for l in counts}
    total = dict.fromkeys(counts, 0)
    upto = dict.fromkeys(counts, 0)  # places below are done
    seen: set[int] = set()
    place = F.pmod(F.xxhash64("text"), F.lit(PLACES))
    for n in range(ROUNDS + 1):
        short = {l: min(PLACES, int(PLACES * SAMPLE_DOCS * MORE**n / max(1, counts[l]))) for l in counts if total[l] < least and upto[l] < PLACES}
        if not short:
            break
        keep = F.lit(False)
        for l, end in short.items():
            keep = keep | ((F.col("lang") == F.lit(l)) & (place >= upto[l]) & (place < end))
        new = rows.where(keep).groupBy("lang", F.xxhash64("text").alias("hash"), place.alias("place")).agg(F.first("text").alias("text"))
        for r in new.orderBy("place", "hash", "lang").toLocalIterator():
            if total[r.lang] < least:
                own = own_words(r.text.split(), seen)
                texts[r.lang].append(f" {' '.join(own)} ")
                total[r.lang] += sum(map(len, own)) + len(own)
        upto |= short
    return texts


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learn from rows with text and language: about ``SAMPLE_SYMBOLS`` symbols per language (fewer if there
    are so many languages that they would pass ``ALL_SYMBOLS``) from whole texts of at most
    ``SAMPLE_BYTES``.  Copies count once, and of passages that sample texts share the first stays."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    by_lang = sampled_texts(rows, lambda n: min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, n)))
    langs = sorted(by_lang)
    table = symbol_table([t for l in langs for t in by_lang[l]])
    machines, bits = [], []
    for l in langs:
        flat = symbols(by_lang[l], table)[0]
        machines.append(automaton(flat, table.width))
        bits.append(float(np.log2(max(2, flat.size))))
    return {"langs": langs, "symbols": table, "machines": machines, "bits": bits}


def classify(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a symbol of each text."""
    texts = [t or "" for t in texts]
    if not model["langs"]:
        return [NONE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    flat, size, letters = symbols(texts, model["symbols"])
    none = letters == 0
    entropy = phrases(flat, size, model["machines"]) * np.asarray(model["bits"]) / np.maximum(1, size)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(texts)), best]
    score = 1 / np.exp2(-np.minimum(60.0, (entropy - least[:, None]) * size[:, None])).sum(axis=1)
    return [NONE if n else model["langs"][b] for n, b in zip(none, best, strict=True)], np.where(none, 0.0, score), least


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred, score, bits`` to all rows.

    ``und`` with score 0 for a text that is null or has no letter (or if no language was
    learned).  Scores are the languages' posterior under code lengths of the measured entropy, 0
    to 1.  Equal entropies go to the first language in order; equal texts, and rows that repeat,
    get equal values; an empty table gives no rows.  A text is parsed from end to end, however
    long it is.  Columns of ``docs`` with the names of the new ones are replaced; all others,
    whatever their names, stay.
    """
    plain = Plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ALL_SYMBOLS, and the symbols
    schema = T.StructType(list(plain.df.schema.fields)).add("lang_pred", "string").add("score", "double").add("bits", "double")
    text = plain.at(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in parts(batch, place, CHUNK):
                langs, scores, bits = classify(part.column(place).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())],
                    [*part.schema.names, "lang_pred", "score", "bits"],
                )

    out = plain.df.mapInArrow(lambda b: released(run(b)), schema)
    return plain.restored(out, added={c: F.col(c) for c in ("lang_pred", "score", "bits")})


def kept(lang_pred: Column, bits: Column, most_bits: float) -> Column:
    """Whether a document is in one of the learned languages: it has letters, and the best
    language explains them in at most ``most_bits`` bits a symbol."""
    return (lang_pred != NONE) & (bits <= most_bits)
