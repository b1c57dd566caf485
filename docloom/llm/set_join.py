"""Exact set-similarity join of sets of 64-bit words, by prefix, positional and length filters; pairs stay packed in units.

Words are ordered from rare to frequent by a table of counts in a fixed number of hash buckets (any fixed order is exact,
only the work depends on it). Two sets with a Jaccard similarity of t share a word among the first n - ceil(t n) + 1
words of each (the prefix), so each set is listed under the words of its prefix; a frequent word is replaced by its
combinations with the two words that may follow it, the prefix being longer by one for each, because two such sets share
three words. A word that occurs once lists nothing.

Sets under one key are paired if their sizes and the key's places leave room for the overlap and 64 parities of their words
don't differ too much; a pair whose words before the key are equal too is left to that earlier word. With classes (roots)
given, only sets of different classes are paired. Keys with many sets are cut into tiles of pairs, dealt over
tasks. A unit gets the words of its sets once; a pair that was met under several keys counts only under the first word
(or words) that the two share, so no pair is made distinct later. Units of connected sets only (`by_sets`) can be brought
together (`homes`), so that a set's words are sent about once, however many keys it shares with others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, mix, stash

COUNT_BITS, SLICES = 22, 64
#: Ranks are counts on a scale of eight steps an octave.
STEPS = 8


def slot(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - COUNT_BITS)).astype(np.int64)


def word_ranks(rows: DataFrame, words_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> tuple[np.ndarray, int]:
    """Rank of the words of each hash bucket by their number over all rows, and the number of all words."""
    table, _, total = counted(rows, words_of, named=False)
    return table, total


def counted(rows: DataFrame, words_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], named: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """word_ranks, between them one word each of the fullest hash buckets (named): at most CODES, for a Codebook."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        name = np.zeros(1 << COUNT_BITS if named else 0, dtype=U64)
        for i, words in enumerate(words for batch in batches for words in words_of(batch)):
            at = slot(words)
            np.add.at(total, at, 1)
            if named and i % 4 == 0:  # a word that is missed only stays without a code
                name[at] = words
        found = []
        for s, part in enumerate(total.reshape(SLICES, -1)):
            some = np.flatnonzero(part)
            often = some[part[some] >= OFTEN] if named else some[:0]
            found.append((s, *(x.tobytes() for x in (some.astype(np.uint32), part[some], often.astype(np.uint32), name[often + s * len(part)] if named else name))))
        cols = list(zip(*found, strict=True))
        yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["slice", "slots", "counts", "often", "names"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << COUNT_BITS) // SLICES, dtype=np.int64)
        for slots, counts in zip(group.column("slots").to_pylist(), group.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(slots, np.uint32)] += np.frombuffer(counts, np.int64)
        rank = np.minimum(STEPS * np.log2(1 + total), 255).astype(np.uint8)
        name = np.zeros(len(total), dtype=U64)
        for often, names in zip(group.column("often").to_pylist(), group.column("names").to_pylist(), strict=True):
            at, own = np.frombuffer(often, np.uint32), np.frombuffer(names, U64)
            name[at] = np.maximum(name[at], own)  # any of them would do
        most = np.argsort(np.where(name > 0, -total, 1), kind="stable")[: 4 * CODES // SLICES]
        most = most[name[most] > 0]
        return pa.table({"slice": group.column("slice").slice(0, 1), "ranks": pa.array([rank.tobytes()], pa.binary()), "n": pa.array([int(total.sum())], pa.int64()), "names": pa.array([name[most].tobytes()], pa.binary()), "counts": pa.array([total[most].tobytes()], pa.binary())})

    found = rows.mapInArrow(each, "slice int, slots binary, counts binary, often binary, names binary").groupBy("slice").applyInArrow(add, "slice int, ranks binary, n long, names binary, counts binary")
    got = stash(found, "counts").collect()  # the shuffle files go
    out = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), dtype=np.uint8)
    for r in got:
        out[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    names, counts = (np.frombuffer(b"".join(r[x] for r in got), kind) for x, kind in (("names", U64), ("counts", np.int64)))
    return out.reshape(-1), names[np.lexsort((names, -counts))[:CODES]], sum(r["n"] for r in got)


#: Words with a code of two bytes, and the code of all others. A task names words that it met so often.
CODES, OFTEN = 65_535, 8


class Codebook:
    """Sets as codes of two bytes a word, and whole the words that have none."""

    def __init__(self, names: np.ndarray):
        self.names = np.append(names, U64(0))
        self.code: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "code": None}

    def codes(self, words: np.ndarray) -> np.ndarray:
        if self.code is None:
            self.code = np.full(1 << COUNT_BITS, CODES, dtype="<u2")
            self.code[slot(self.names[:-1])] = np.arange(len(self.names) - 1)
        code = self.code[slot(words)]
        known = code < CODES
        known[known] = self.names[code[known]] == words[known]
        return np.where(known, code, CODES).astype("<u2")

    def encoded(self, words: np.ndarray, o: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Codes and other words of each set."""
        code = self.codes(words)
        other = np.flatnonzero(code == CODES)
        at = np.searchsorted(other, o)
        raw = lambda x, o: pa.array([x[i:j].tobytes() for i, j in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.binary())
        return raw(code, o), raw(words[other], at)

    def decoded(self, codes: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of the sets, a number from 0 for each different one, and the sets' offsets."""
        code = np.frombuffer(b"".join(codes), "<u2")
        words = self.names[np.minimum(code, len(self.names) - 1)]
        number, rest, other = code.astype(np.int64), code == CODES, np.frombuffer(b"".join(others), U64)
        words[rest] = other
        number[rest] = CODES + np.unique(other, return_inverse=True)[1].reshape(-1)
        return words, number, np.concatenate(([0], np.cumsum([len(x) // 2 for x in codes])))


class Plan:
    """Numbers that follow from the threshold: sizes that can match, prefixes, and words in the key of a frequent word."""

    def __init__(self, t: float, frequent: int = 1 << 16):
        self.t = t
        self.least = math.ceil(1 / (1 - t) - 1e-9) - 1 if t < 1 else 1 << 30
        self.depth = min(3, self.least)
        self.hot_rank = int(STEPS * math.log2(1 + frequent))

    def prefix(self, n: int) -> int:
        return n - math.ceil(self.t * n - 1e-9) + 1

    def need(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.ceil(self.t / (1 + self.t) * (n + m) - 1e-9)


#: before is the word before the key's first one, 0 where that is the first of all. n and left stop at the largest number of 16 bits, which only lets more candidates through.
POSTING = np.dtype([("key", "<u4"), ("n", "<u2"), ("left", "<u2"), ("c1", "<i8"), ("bits", "<u8"), ("before", "<u8")])
#: With the class of the set.
CLASSED = np.dtype([*POSTING.descr, ("root", "<i8")])
ONE, THREE = U64(1), U64(3)


def single_key(a: np.ndarray) -> np.ndarray:
    return mix(a + ONE)


def joint_key(words: list[np.ndarray]) -> np.ndarray:
    key = words[0] + THREE
    for w in words[1:]:
        key = mix(key) + w
    return mix(key)


def _places(first: int, prefix: int, n: int, depth: int) -> np.ndarray:
    """[combinations, depth] rising places with the first in [first, prefix) and each next one below a prefix longer by one."""
    out = np.arange(first, prefix)[:, None]
    for level in range(1, depth):
        end = min(prefix + level, n)
        counts = np.maximum(end - 1 - out[:, -1], 0)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out = np.repeat(out, counts, axis=0)
        out = np.concatenate((out, (out[:, -1] + 1 + step)[:, None]), axis=1)
    return out


def parity(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 parities of each set: two sets differ in at least as many words as their parities differ in bits."""
    out = np.zeros(len(offsets) - 1, dtype=U64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.bitwise_xor.reduceat(U64(1) << (mix(words + U64(9)) & U64(63)), offsets[some])
    return out


def postings(plan: Plan, ranks: np.ndarray, buckets: int, words: np.ndarray, o: np.ndarray, c1: np.ndarray, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Postings of sets (words by rank and value, offsets o) that can match another, and the buckets of their keys."""
    n = np.diff(o)
    bits = parity(words, o)
    for size in np.unique(n[n >= plan.least]).tolist():
        every = np.flatnonzero(n == size)
        prefix = plan.prefix(size)
        width = min(prefix + plan.depth - 1, size)
        step = max(1, (1 << 22) // width)
        for i in range(0, len(every), step):
            some = every[i : i + step]
            own = words[o[some][:, None] + np.arange(width)]
            rank = ranks[slot(own[:, :prefix])]
            hot = np.where(rank[:, -1] > plan.hot_rank, (rank > plan.hot_rank).argmax(axis=1), prefix)  # ranks rise
            for first in np.unique(hot).tolist():
                rows = np.flatnonzero(hot == first)
                keys, places, shared = [single_key(own[rows, :first])], [np.arange(first)], [rank[rows, :first] > STEPS]
                if first < prefix:
                    joint = _places(first, prefix, size, plan.depth)
                    keys.append(joint_key([own[rows][:, joint[:, level]] for level in range(plan.depth)]))
                    places.append(joint[:, 0])
                    shared.append(np.ones((len(rows), len(joint)), dtype=bool))
                key, place, take = np.concatenate(keys, axis=1), np.concatenate(places), np.concatenate(shared, axis=1)
                out = np.empty(key.shape, dtype=POSTING if root is None else CLASSED)
                out["key"] = (key >> U64(32)).astype(np.uint32)
                for name, x in (("c1", c1), ("bits", bits)):
                    out[name] = x[some[rows]][:, None]
                out["n"], out["left"] = min(size, 65535), np.minimum(size - place, 65535)
                out["before"] = np.where(place > 0, own[rows][:, np.maximum(place - 1, 0)], U64(0))
                if root is not None:
                    out["root"] = root[some[rows]][:, None]
                yield out[take], (key[take] % U64(buckets)).astype(np.int64)


def packed(found: Iterator[tuple[np.ndarray, np.ndarray]], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Postings as rows (bucket, postings)."""

    def out(held: list) -> pa.RecordBatch:
        rows, where = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(where.astype(np.uint16) if where.max() < 1 << 16 else where, kind="stable")  # by counting, if short
        rows, where = rows[order], where[order]
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        ends = np.append(cut[1:], len(rows))
        return pa.record_batch([pa.array(where[cut], pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "postings"])

    held, size = [], 0
    for rows, where in found:
        if len(rows):
            held.append((rows, where))
            size += rows.nbytes
        if size > limit:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def pack_pairs(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> bytes:
    """Places of members and the keys under which they met, rows of one key behind each other."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    kind = np.uint16 if max(a.max(), b.max()) < 1 << 16 else np.uint32
    head = np.array([len(cut), len(a), np.dtype(kind).itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, key[cut], np.diff(np.append(cut, len(key))).astype(np.uint32), a.astype(kind), b.astype(kind)))


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists, n, width = np.frombuffer(raw, np.int64, 3).tolist()
    key, counts = np.frombuffer(raw, np.uint32, 2 * lists, 24).reshape(2, -1)
    a, b = np.frombuffer(raw, f"<u{width}", 2 * n, 24 + 8 * lists).astype(np.int64).reshape(2, -1)
    return a, b, np.repeat(key, counts)


UNITS = "gid long, c1 long, at int, pairs binary, tile binary"
_NO_UNIT = pa.table({"gid": pa.array([], pa.int64()), "c1": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "pairs": pa.array([], pa.binary()), "tile": pa.array([], pa.binary())})


def _columns(rows: np.ndarray) -> dict[str, np.ndarray]:
    """The fields that _fitting reads, each for itself."""
    return {x: np.ascontiguousarray(rows[x]) for x in rows.dtype.names if x not in ("key", "c1")}


def _fitting(plan: Plan, rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (places in rows) pass the filters."""
    n, m = rows["n"][a], rows["n"][b]
    both = n.astype(np.int32) + m
    need = plan.need(np.arange(int(both.max(initial=0)) + 1), 0).astype(np.int32)
    good = np.flatnonzero(np.minimum(rows["left"][a], rows["left"][b]) >= need[both])
    both, a, b, out = both[good], a[good], b[good], np.zeros(len(a), dtype=bool)
    some = np.flatnonzero(np.bitwise_count(rows["bits"][a] ^ rows["bits"][b]) <= both - 2 * need[both])
    good, a, b = good[some], a[some], b[some]
    before = rows["before"][a]
    fit = (before != rows["before"][b]) | (before == 0)  # else that word is an earlier key of the pair
    n, m = rows["n"][a].astype(np.int64), rows["n"][b].astype(np.int64)
    fit &= np.minimum(n, m) >= plan.t * np.maximum(n, m) - 1e-9
    if "root" in rows:
        fit &= rows["root"][a] != rows["root"][b]
    out[good[fit]] = True
    return out


def _unit(gid: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Members and pairs of a unit; a, b are places in rows."""
    at, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    names, again = np.unique(rows["c1"][at], return_inverse=True)  # a set is listed under several keys
    back = again.reshape(-1)[back]
    raw, n = pack_pairs(back[: len(a)], back[len(a) :], rows["key"][a]), len(names)
    return pa.table({"gid": pa.array(np.full(n, gid)), "c1": pa.array(names), "at": pa.array(np.arange(n, dtype=np.int32)), "pairs": pa.array([raw] + [None] * (n - 1), pa.binary()), "tile": pa.nulls(n, pa.binary())})


#: A unit as one row: sets that pairs connect, by rising hash, the least of them, the words of all pairs, and the pairs.
PARTS = "gid long, name long, weight long, members binary, pairs binary, tile binary"
_NO_PART = pa.table({"gid": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "weight": pa.array([], pa.int64()), "members": pa.array([], pa.binary()), "pairs": pa.array([], pa.binary()), "tile": pa.array([], pa.binary())})
PAIR = np.dtype([("key", "<u4"), ("a", "<u4"), ("b", "<u4")])
UNIT_WORDS = 6_400_000


def connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that pairs of places connect with each of n."""
    root = np.arange(n)
    while True:
        now, x, y = root.copy(), root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        while ((up := now[now]) != now).any():
            now = up
        if (now == root).all():
            return root
        root = now


def _parts(gid: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray, split: bool = True) -> pa.Table:
    """Units of the connected sets among pairs (a, b are places in rows), or one of all of them."""
    at, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    names, again = np.unique(rows["c1"][at], return_inverse=True)
    left, right = again.reshape(-1)[back.reshape(-1)].reshape(2, -1)
    root = connected(left, right, len(names)) if split else np.zeros(len(names), dtype=np.int64)
    members = np.argsort(root, kind="stable")
    least, begin = np.unique(root[members], return_index=True)
    ends = np.append(begin[1:], len(names))
    place = np.empty(len(names), dtype=np.int64)
    place[members] = np.arange(len(names)) - np.repeat(begin, ends - begin)
    order = np.argsort(root[left], kind="stable")
    pairs = np.empty(len(a), dtype=PAIR)
    pairs["key"], pairs["a"], pairs["b"] = rows["key"][a[order]], place[left[order]], place[right[order]]
    cut = np.searchsorted(root[left[order]], np.append(least, len(names)))
    words = np.bincount(root[left], rows["n"][a].astype(np.int64) + rows["n"][b], len(names))[least].astype(np.int64)
    hashes = names[members]
    raw = lambda x, lo, hi: pa.array([x[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
    return pa.table({"gid": pa.array(gid + np.arange(len(least))), "name": pa.array(names[least]), "weight": pa.array(words), "members": raw(hashes, begin, ends), "pairs": raw(pairs, cut[:-1], cut[1:]), "tile": pa.nulls(len(least), pa.binary())})


def _by_key(rows: np.ndarray) -> np.ndarray:
    """The order by key and n, the postings of one set under a key behind each other, those with the most words left first."""
    code = rows["key"].astype(U64) << U64(32) | rows["n"].astype(U64) << U64(16) | rows["c1"].astype(U64) & U64(0xFFFF)
    order = np.argsort(code)
    code, c1, left = code[order], rows["c1"][order], rows["left"][order]
    mixed = (code[1:] == code[:-1]) & ((c1[1:] != c1[:-1]) | (left[1:] != left[:-1]))
    if mixed.any():  # few: sets that agree in 16 bits, or have two words of one key
        some = np.flatnonzero(np.isin(code, code[1:][mixed]))
        order[some] = order[some][np.lexsort((-left[some].astype(np.int64), c1[some], code[some]))]
    return order


def candidates(rows: DataFrame, plan: Plan, kind: np.dtype = POSTING, tile: int = 2048, unit_words: int = UNIT_WORDS, chunk: int = 1 << 21, by_sets: bool = False) -> DataFrame:
    """Units: rows (gid, at, c1) of their members, the first with all pairs, or one row each (by_sets); and tiles, rows with a part of a long list."""
    classed = "root" in kind.names
    none = _NO_PART if by_sets else _NO_UNIT

    def join(group: pa.Table) -> pa.Table:
        gid = group.column("bucket")[0].as_py() << 32
        rows = np.concatenate([np.frombuffer(x, kind) for x in group.column("postings").to_pylist()])
        rows = rows[np.lexsort((-rows["left"].astype(np.int64), rows["c1"], rows["n"], rows["root"], rows["key"])) if classed else _by_key(rows)]
        again = np.zeros(len(rows), dtype=bool)
        again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["c1"][1:] == rows["c1"][:-1])
        rows = rows[~again]
        cut = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
        ends = np.append(cut[1:], len(rows))
        sizes = ends - cut
        number = np.repeat(np.arange(len(cut)), sizes)
        place = np.arange(len(rows))
        if classed:  # with all sets behind those of the same class
            runs = np.flatnonzero(np.concatenate(([True], (rows["root"][1:] != rows["root"][:-1]) | (number[1:] != number[:-1]))))
            start = np.repeat(np.append(runs[1:], len(rows)), np.diff(np.append(runs, len(rows))))
            partners = ends[number] - start
        else:  # with the sets behind it that aren't too large
            code = number << 17 | rows["n"].astype(np.int64)
            most = np.minimum(np.floor(rows["n"] / plan.t + 1e-9), 65535).astype(np.int64)
            start = place + 1
            partners = np.searchsorted(code, number << 17 | most, "right") - start
        out, columns = [none], _columns(rows)
        for x in np.flatnonzero((sizes > tile) & (np.add.reduceat(partners, cut) > 0)).tolist():  # long lists: tiles of pairs for other tasks
            steps = range(cut[x], ends[x], tile // 2)
            partners[cut[x] : ends[x]] = 0
            for p in steps:
                left = rows[p : min(p + tile // 2, ends[x])]
                for q in steps:
                    right = rows[q : min(q + tile // 2, ends[x])]
                    apart = right["root"][-1] != left["root"][0] if classed else right["n"][0] <= left["n"][-1] / plan.t + 1e-9
                    if q >= p and apart:
                        raw = np.int64(len(left)).tobytes() + left.tobytes() + (right.tobytes() if q > p else b"")
                        out.append(pa.table([pa.array([gid], pa.int64()), *(pa.nulls(1, t) for t in none.schema.types[1:-1]), pa.array([raw], pa.binary())], names=none.column_names))
                        gid += 1
        done = np.concatenate(([0], np.cumsum(partners)))
        at = 0
        while at < len(rows):
            stop = int(ends[max(np.searchsorted(done[ends], done[at] + chunk, "right") - 1, number[at])])
            n = partners[at:stop]
            a = np.repeat(place[at:stop], n)
            b = np.repeat(start[at:stop] - (done[at:stop] - done[at]), n) + np.arange(len(a))
            good = _fitting(plan, columns, a, b)
            a, b = a[good], b[good]
            at = stop
            if len(a):
                words = np.cumsum(rows["n"][a].astype(np.int64) + rows["n"][b])  # at most; whole lists stay together
                part = words[np.searchsorted(number[a], number[a])] // unit_words
                for c in np.unique(part):
                    some = part == c
                    out.append((_parts if by_sets else _unit)(gid, rows, a[some], b[some]))
                    gid += out[-1].num_rows if by_sets else 1
        return pa.concat_tables(out)

    return rows.groupBy("bucket").applyInArrow(join, PARTS if by_sets else UNITS)


def tiled(tiles: DataFrame, plan: Plan, kind: np.dtype = POSTING, by_sets: bool = False) -> DataFrame:
    """Units from the tiles of long lists."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, rows = int(np.frombuffer(raw, np.int64, 1)[0]), np.frombuffer(raw, kind, -1, 8)
                a, b = np.triu_indices(n, 1) if len(rows) == n else (x.reshape(-1) for x in np.indices((n, len(rows) - n)))
                b = b if len(rows) == n else b + n
                good = _fitting(plan, _columns(rows), a, b)
                if good.any():
                    yield from (_parts(gid, rows, a[good], b[good], split=False) if by_sets else _unit(gid, rows, a[good], b[good])).to_batches()

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.select("gid", "tile").repartition(parts, "gid").mapInArrow(each, PARTS if by_sets else UNITS)


def unrolled(units: DataFrame, name: str) -> DataFrame:
    """Rows (gid, c1, `name`) of the members of units, `name` being a column of numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            at = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))
            yield pa.record_batch([batch.column(0).take(at), pa.array(np.frombuffer(b"".join(raw), np.int64)), batch.column(2).take(at)], ["gid", "c1", name])

    return units.select("gid", "members", name).mapInArrow(each, f"gid long, c1 long, {name} long")


def homes(units: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Units (see PARTS) with dest: those that share sets go together as long as their pairs have up to unit_words words.

    A set goes by the least name of its units, a unit by the least of its sets; which units meet changes no result.
    """
    total = units.agg(F.sum("weight")).first()[0] or 0
    low = unrolled(units, "name").withColumn("low", F.min("name").over(W.partitionBy("c1")))
    home = units.select("gid", "weight").hint("merge").join(low.groupBy("gid").agg(F.min("low").alias("home")), "gid")
    part = F.floor(F.sum("weight").over(W.partitionBy("home").orderBy("gid")) / unit_words)
    dest = stash(home.select("gid", F.pmod(F.xxhash64("home", part), F.lit(max(16, total // unit_words))).alias("dest")), "homes")
    return units.select("gid", "members", "pairs").hint("merge").join(dest, "gid")


def links_of(group: pa.Table, plan: Plan, ranks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of a unit's links (rows by `at`, with their words), each link once among all units."""
    raw = group.column("words").to_pylist()
    words, o = np.frombuffer(b"".join(raw), U64), np.concatenate(([0], np.cumsum([len(w) // 8 for w in raw])))
    left, right, met = unpack_pairs(next(p for p in group.column("pairs").to_pylist() if p is not None))
    return _linked(words, np.unique(words, return_inverse=True)[1], o, left, right, met, np.full(len(left), group.column("gid")[0].as_py() >> 32), plan, ranks, buckets)


def links_together(units: pa.Table, sets: pa.Table, book: Codebook, plan: Plan, ranks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As links_of, of units of one dest; places in sets (c1, codes, others; by rising c1)."""
    words, number, o = book.decoded(sets.column("codes").to_pylist(), sets.column("others").to_pylist())
    members, pairs = units.column("members").to_pylist(), units.column("pairs").to_pylist()
    place = np.searchsorted(sets.column("c1").to_numpy(), np.frombuffer(b"".join(members), np.int64))
    counts = [len(p) // PAIR.itemsize for p in pairs]
    begin = np.repeat(np.cumsum([0, *(len(m) // 8 for m in members)])[:-1], counts)
    pairs = np.frombuffer(b"".join(pairs), PAIR)
    a, b = place[begin + pairs["a"]], place[begin + pairs["b"]]
    return _linked(words, number, o, a, b, pairs["key"], np.repeat(units.column("gid").to_numpy() >> 32, counts), plan, ranks, buckets)


def _linked(words: np.ndarray, local: np.ndarray, o: np.ndarray, a: np.ndarray, b: np.ndarray, met: np.ndarray, bucket: np.ndarray, plan: Plan, ranks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of sets (words, their numbers, offsets o) that are links and were met under the first key they share."""
    code, again = np.unique(np.minimum(a, b) * len(o) + np.maximum(a, b), return_inverse=True)
    left, right = code // len(o), code % len(o)
    key, linked = np.zeros(len(code), dtype=U64), np.zeros(len(code), dtype=bool)
    n = np.diff(o)
    where = np.full(local.max(initial=-1) + 1, -1, dtype=np.int64)  # place of a word in the set at hand
    cut = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(left)], strict=True):
        x = int(left[lo])
        mine, own = local[o[x] : o[x + 1]], words[o[x] : o[x + 1]]
        where[mine] = np.arange(len(mine))
        for i in range(lo, hi, 1024):
            y = right[i : min(i + 1024, hi)]
            ends = np.cumsum(n[y])
            at = where[local[np.arange(ends[-1]) + np.repeat(o[y] - (ends - n[y]), n[y])]]
            both = at >= 0
            shared = np.add.reduceat(both, ends - n[y], dtype=np.int64)
            link = np.flatnonzero(shared >= plan.t * (n[x] + n[y] - shared) - 1e-9)
            if len(link):
                common = at[both]  # in the order of the words for each pair
                begin = (np.cumsum(shared) - shared)[link]
                one = single_key(own[common[begin]])
                hot = ranks[slot(own[common[begin]])] > plan.hot_rank
                if hot.any():
                    one = np.where(hot, joint_key([own[common[begin + level]] for level in range(plan.depth)]), one)
                key[i + link], linked[i + link] = one, True
        where[mine] = -1
    again = again.reshape(-1)
    once = linked[again] & (key[again] >> U64(32) == met) & (key[again] % U64(buckets) == bucket.astype(U64))
    return a[once], b[once]


__all__ = ["CLASSED", "POSTING", "Codebook", "Plan", "candidates", "connected", "counted", "homes", "links_of", "links_together", "packed", "postings", "slot", "tiled", "unrolled", "word_ranks"]
