"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(_LOW))


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = set()
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0]))[0]
        for i, _ in own:
            out.add((i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def contaminated(rows, items, window=13):
    grams = defaultdict(set)
    sizes = set()
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        if n:
            sizes.add(n)
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])].add(str(item))
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = grams.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(rows, size=50):
    first = {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
    out = {}
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = 1
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def token_rows(rows, tokenizer, end_id):
    out, start = {}, 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def shingle_counts(text, k=5):
    w = words(text)
    out = defaultdict(int)
    if len(w) < k and w:
        out[tuple(w)] += 1
    for i in range(len(w) - k + 1):
        out[tuple(w[i : i + k])] += 1
    return out


def multiset_similarity(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def near_classes(rows, threshold=0.8):
    """doc -> smallest doc of its class: components of pairs at or above the threshold."""
    rows = sorted(rows, key=lambda r: r[0])
    counts = {d: shingle_counts(t) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, c in counts.items():
        for s in c:
            by[s].append(d)
    pairs = {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y and multiset_similarity(counts[a], counts[b]) >= threshold:
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def similar_lines(rows, t=0.8):
    """doc -> (n_lines, n_removed, n_links)."""
    lines = []
    for d, text in sorted(rows, key=lambda r: r[0]):
        parts = (text or "").split("\n")
        if parts[-1] == "":
            parts.pop()
        lines += [(d, i, frozenset(words(p))) for i, p in enumerate(parts)]
    first = {}
    for d, i, s in lines:
        if s:
            first.setdefault(s, (d, i))
    by = defaultdict(list)
    for s in first:
        for w in s:
            by[w].append(s)
    links, drop = defaultdict(int), set()
    for s in first:
        shared = defaultdict(int)
        for w in s:
            for o in by[w]:
                shared[o] += 1
        for o, n in shared.items():
            if o != s and n >= t * (len(s) + len(o) - n) - 1e-9:
                links[s] += 1
                if first[o] < first[s]:
                    drop.add(s)
    out = {d: [0, 0, set()] for d, _ in rows}
    for d, i, s in lines:
        out[d][0] += 1
        if s:
            out[d][1] += first[s] != (d, i) or s in drop
            out[d][2].add(s)
    return {d: (n, gone, sum(links[s] for s in own)) for d, (n, gone, own) in out.items()}
