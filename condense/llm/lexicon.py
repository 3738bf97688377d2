"""Minimal acyclic transducer from byte words to id sequences, kept in one memory-mapped file.

States are shared by suffix (Daciuk's incremental construction over sorted words).  Each edge
carries the number of accepted words that sort before it among the words of its source state,
so the sum along a path is the word's rank, and the rank addresses its ids: outputs stay out of
the states, which keeps the automaton minimal.
"""

from __future__ import annotations

import numpy as np

_ORDER = ("edge_key", "edge_to", "edge_skip", "final", "start", "ids")
_TYPES = {"edge_key": "<u8", "edge_to": "<u4", "edge_skip": "<u4", "final": "u1", "start": "<u8", "ids": "<u4"}


def build(entries: dict[bytes, list[int]], path: str) -> None:
    """Compile ``entries`` (word: ids) and write the automaton to ``path``."""
    words = sorted(entries)
    children: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    chain: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet minimised

    def minimise(down_to: int) -> None:
        while len(chain) > down_to:
            parent, byte, child = chain.pop()
            key = (final[child], tuple(children[child].items()))
            kept = register.setdefault(key, child)
            if kept != child:
                children[parent][byte] = kept

    last = b""
    for w in words:
        n = 0
        while n < len(last) and n < len(w) and last[n] == w[n]:
            n += 1
        minimise(n)
        state = chain[-1][2] if chain else 0
        for byte in w[n:]:
            children.append({})
            final.append(False)
            new = len(children) - 1
            children[state][byte] = new
            chain.append((state, byte, new))
            state = new
        final[state] = True
        last = w
    minimise(0)

    count: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:  # words below each state, children first
        s, done = stack.pop()
        if done:
            if s not in count:
                count[s] = final[s] + sum(count[c] for c in children[s].values())
                order.append(s)
        elif s not in count:
            stack.append((s, True))
            stack += [(c, False) for c in children[s].values() if c not in count]
    number = {s: i for i, s in enumerate([0] + [s for s in order if s])}
    rows = []
    for s, i in number.items():
        skip = int(final[s])
        for byte, c in sorted(children[s].items()):
            rows.append((i << 8 | byte, number[c], skip))
            skip += count[c]
    rows.sort()
    col = lambda j: [r[j] for r in rows]
    flags = np.zeros(len(number), "u1")
    for s, i in number.items():
        flags[i] = final[s]
    arrays = {
        "edge_key": col(0), "edge_to": col(1), "edge_skip": col(2), "final": flags,
        "start": np.cumsum([0] + [len(entries[w]) for w in words]),
        "ids": [x for w in words for x in entries[w]],
    }
    arrays = {k: np.asarray(arrays[k], _TYPES[k]) for k in _ORDER}
    with open(path, "wb") as f:
        f.write(np.asarray([arrays[k].size for k in _ORDER], "<u8").tobytes())
        for k in _ORDER:
            f.write(b"\0" * (-f.tell() % 8))
            f.write(arrays[k].tobytes())


class Lexicon:
    """Read side of :func:`build`: nothing is loaded, the arrays are views of the mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        at = 8 * len(_ORDER)
        for k, n in zip(_ORDER, raw[:at].view("<u8").tolist(), strict=True):
            at += -at % 8
            size = n * np.dtype(_TYPES[k]).itemsize
            setattr(self, k, raw[at:at + size].view(_TYPES[k]))
            at += size

    def lookup(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each word (consecutive runs of bytes) begin, -1 if the word is not
        in the lexicon, and how many they are.  All words step through the automaton together, one
        byte a round."""
        n = size.size
        first, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if not n or not self.edge_key.size:
            return first, count
        at = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state, rank = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        depth = 0
        while live.size:
            key = state[live] << np.uint64(8) | data[at[live] + depth]
            edge = np.searchsorted(self.edge_key, key)
            edge[edge == self.edge_key.size] = 0
            hit = self.edge_key[edge] == key
            live, edge = live[hit], edge[hit]
            state[live] = self.edge_to[edge]
            rank[live] += self.edge_skip[edge]
            depth += 1
            over = size[live] == depth
            ended = live[over]
            ended = ended[self.final[state[ended].astype(np.int64)] > 0]
            first[ended] = self.start[rank[ended]]
            count[ended] = self.start[rank[ended] + 1] - self.start[rank[ended]]
            live = live[~over]
        return first, count
