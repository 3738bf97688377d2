"""Plain versions of the operators, for small inputs."""

import re

import numpy as np


def check_packed(rows, ids_of):
    """Every id in exactly one piece, in order; gapless sequences without padding.  Returns pieces."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids_of)
    for i, ids in ids_of.items():
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for r in own) and [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    for own in bins.values():
        own = sorted(own, key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and 0 < total <= 2048
        assert total == 2048 or total & (total - 1) == 0  # no padding
    return bins


def brute_repeats(docs, n=20):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            if key in seen:
                gone[s:s + n] = [True] * n
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def brute_lines(docs, n=3):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        ls = None if t is None else t.split("\n")
        gone = [False] * len(ls or [])
        for s in range(len(ls or []) - n + 1):
            key = tuple(ls[s:s + n])
            if key in seen:
                gone[s:s + n] = [True] * n
            seen.add(key)
        out[i] = (len(ls or []), sum(gone), None if ls is None else "\n".join(x for x, g in zip(ls, gone, strict=True) if not g))
    return out


def brute_rich_lines(docs, least, n=3):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        ls = None if t is None else t.split("\n")
        gone = [False] * len(ls or [])
        for m in range(1, n + 1):
            for s in range(len(ls or []) - m + 1):
                key = tuple(ls[s:s + m])
                if m < n and sum(len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in key) < least:
                    continue
                if key in seen:
                    gone[s:s + m] = [True] * m
                seen.add(key)
        out[i] = (len(ls or []), sum(gone), None if ls is None else "\n".join(x for x, g in zip(ls, gone, strict=True) if not g))
    return out


def multiset(t):
    w = (t or "").encode().split()
    own = [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen, out = {}, set()
    for s in own:
        seen[s] = seen.get(s, 0) + 1
        out.add((s, seen[s]))
    return out


def groups(texts, least=0.8):
    sets = [multiset(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def longest_parse(text, sample):
    at, n = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at:at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n
