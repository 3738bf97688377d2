"""Exact BPE merges of many words at once.

Words stand as columns of a matrix of symbol ids.  In each round every column merges its leftmost
pair of lowest rank, the order in which the tokenizers library merges; only the two pairs beside
the merged one are looked up anew.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
#: Words merged at a time.
BLOCK = 16384


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """Merge table of a byte-level BPE tokenizer file."""

    LONGEST = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_alphabet()
        self.inner = np.asarray([vocab[c] for c in chars], np.int32)
        self.outer = np.asarray([vocab[c + suffix] for c in chars], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.asarray([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.result = np.asarray([vocab[a + b] for a, b in pairs], np.int32)
        slot = self._slot(key)
        self.keys = np.full(1 << _BITS, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << _BITS, _NONE, np.int32)
        self.keys[slot], self.ranks[slot] = key, rank
        lost = self.keys[slot] != key  # another pair has the slot
        self.shared = np.zeros(1 << _BITS, bool)
        self.shared[slot[lost]] = True
        order = np.argsort(key[lost])
        self.more_keys, self.more_ranks = key[lost][order], rank[lost][order]

    @staticmethod
    def _slot(key):
        return (key * _ODD >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, a, b):
        """Rank of the pairs (a, b), or ``_NONE``; a negative id stands for nothing."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        rest = np.flatnonzero(self.shared[slot] & (out == _NONE))
        if rest.size:
            at = np.minimum(np.searchsorted(self.more_keys, key[rest]), self.more_keys.size - 1)
            out[rest] = np.where(self.more_keys[at] == key[rest], self.more_ranks[at], _NONE)
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (1 to ``LONGEST`` bytes of ``data`` each) in a row, and how many each has."""
        counts = np.zeros(size.size, np.int64)
        order = np.argsort(size, kind="stable")
        blocks = []
        for s in range(0, order.size, BLOCK):
            own = order[s:s + BLOCK]
            ids, counts[own] = self._block(data, start[own], size[own])
            blocks.append(ids)
        if not blocks:
            return np.zeros(0, "<u4"), counts
        ids = np.concatenate(blocks)
        ends = np.cumsum(counts[order])
        first = np.zeros(size.size, np.int64)
        first[order] = ends - counts[order]
        ends = np.cumsum(counts)
        return ids[np.arange(ids.size) + np.repeat(first - (ends - counts), counts)], counts

    def _block(self, data, start, size):
        """Words side by side as columns; ``best`` holds rank and place of each pair in one number,
        so the least of a column names the next merge."""
        n, wide = size.size, int(size.max())
        rows = np.arange(wide, dtype=np.int64)[:, None]
        there = rows < size
        raw = data[np.minimum(start + rows, data.size - 1)]
        sym = np.where(there, self.inner[raw], np.int32(-1))
        cols = np.arange(n)
        sym[size - 1, cols] = self.outer[raw[size - 1, cols]]
        final = sym.copy()
        live = cols
        if wide > 1:
            best = self._keyed(sym[:-1], sym[1:], rows[:-1].astype(np.int32))
        while sym.shape[0] > 1:
            least = best.min(axis=0)
            over = least == _NONE
            if over.any():
                done = live[over]
                final[:, done] = -1
                final[:sym.shape[0], done] = sym[:, over]
                keep = np.flatnonzero(~over)
                live = live[keep]
                if not live.size:
                    break
                sym, best, least = sym[:, keep], best[:, keep], least[keep]
            at = least & 63
            cols = np.arange(live.size)
            rows = np.arange(sym.shape[0] - 1, dtype=np.int32)[:, None]
            sym = np.where(rows > at, sym[1:], sym[:-1])
            sym[at, cols] = self.result[least >> 6]
            rows = rows[:-1]
            best = np.where(rows >= at, best[1:] - (best[1:] != _NONE), best[:-1])  # what moved is one place further to the front
            left = np.flatnonzero(at > 0)
            p = at[left] - 1
            best[p, left] = self._keyed(sym[p, left], sym[p + 1, left], p)
            right = np.flatnonzero(at < best.shape[0])
            p = at[right]
            best[p, right] = self._keyed(sym[p, right], sym[p + 1, right], p)
        if live.size:  # one symbol is left of each
            final[:, live] = -1
            final[:1, live] = sym
        flat = final.T
        counts = (flat >= 0).sum(axis=1)
        return flat[flat >= 0].astype("<u4"), counts

    def _keyed(self, a, b, place):
        rank = self.rank(a.ravel(), b.ravel()).reshape(a.shape)
        return np.where(rank == _NONE, _NONE, (rank << 6) | place)
