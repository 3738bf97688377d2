"""Hashes of words and of word windows, for many texts at a time.

A word is a run of bytes other than space and 9 to 13, as ``bytes.split()`` cuts.  Hashes are
polynomials modulo 2**64 over random byte values, mixed at the end, and so are those of windows
over their words; equal words and windows have equal hashes on every machine.
"""

from __future__ import annotations

import functools

import numpy as np

_U = np.uint64
_BYTE_ODD = 0x9E3779B97F4A7C15
_WORD_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse modulo 2**64.  Only the longest
    row of each number is held."""
    if odd not in _held or _held[odd][0].size < n:
        size = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(size, odd, _U), np.full(size, pow(odd, -1, 2**64), _U)
        up[0] = down[0] = 1
        _held[odd] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    up, down = _held[odd]
    return up[:n], down[:n]


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def words(texts: list[bytes], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in a row, and each text's number of words."""
    hashes, counts, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) < block):
            n += len(texts[end]) + 1
            end += 1
        h, c = _words(texts[at:end])
        hashes.append(h)
        counts.append(c)
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b" ".join(texts) + b" ", "u1")
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    white = _WHITE[flat]
    last = np.flatnonzero(~white[:-1] & white[1:]) + 1  # one behind each word's end
    first = np.flatnonzero(~white & np.r_[True, white[:-1]])
    up, down = powers(_BYTE_ODD, flat.size)
    total = np.zeros(flat.size + 1, _U)
    np.cumsum(_byte_values()[flat] * up, out=total[1:])
    h = mix((total[last] - total[first]) * down[first] ^ (last - first).astype(_U) << _U(48))
    ends = np.searchsorted(first, np.cumsum(size))
    return h, np.diff(np.concatenate(([0], ends)))


class Windows:
    """Hashes of windows over a row of word hashes."""

    def __init__(self, h: np.ndarray):
        self.n = h.size
        self.sums = []
        for odd in _WORD_ODD:
            up, down = powers(odd, max(1, self.n))
            total = np.zeros(self.n + 1, _U)
            np.cumsum(h * up, out=total[1:])
            self.sums.append((total, down))

    def hashes(self, start: np.ndarray, length, which: int = 0) -> np.ndarray:
        """Of the windows of ``length`` words that begin at ``start``."""
        total, down = self.sums[which]
        return mix((total[start + length] - total[start]) * down[start] + np.asarray(length).astype(_U))


def window_starts(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` words within texts of ``counts`` words, and whose they are."""
    first = np.cumsum(counts) - counts
    n = np.maximum(0, counts - length + 1)
    owner = np.repeat(np.arange(counts.size), n)
    within = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
    return first[owner] + within, owner


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or other ``best``) of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x
