"""Removal of byte strings that an earlier document holds, by a logarithmic family of sparse suffix arrays.

A byte is removed if a string of `window` bytes that covers it also starts in a document with a smaller id. Comparing all
windows would move every byte fifty times, so suffixes are sampled by content: each window has an anchor, the k-gram in
it with the least hash (the leftmost of ties). Equal windows have equal anchors at equal places, so only windows with the
same anchor need comparing, and the windows of one anchor are one stretch of text, its context.

1. Every document lists its anchors with a hash of each context. Blocks of documents settle copies of a context among
   themselves and send one posting per context on, to the bucket of the anchor.
2. A bucket sorts its postings. A context that an earlier document has too goes as a whole. The first copy of a context
   whose anchor occurs in earlier documents in other contexts must be compared: its bytes are asked for.
3. The bytes asked for come to the bucket in the order of the documents. Batch by batch they become suffix arrays (the
   windows in sorted order), are merge-scanned against the levels that hold all earlier batches, and enter the family:
   levels of equal size merge, so there are few of them and each window is merged a logarithmic number of times.
4. Every document takes its verdicts and is cut.

Null text counts as empty; a null id is smaller than any other and its documents are one; documents with the same id never
remove from each other; texts shorter than the window stay; an empty table gives an empty result; other columns are
ignored. Context hashes have 96 bits together with their anchor's; the windows themselves are compared as bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, byte_view, mix, prefix_hash, span_hash, stash

NO_ID = np.iinfo(np.int64).min
ANCHOR_BITS = 48


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: row, first and last window start, 48-bit hash of the anchor, 48-bit hash of the context. offsets[0] must be 0."""
    none = np.zeros(0, dtype=np.int64)
    n, sizes = len(data), np.diff(offsets)
    if n < window or sizes.max(initial=0) < window:
        return none, none, none, none.astype(U64), none.astype(U64)
    prefix = prefix_hash(data)
    place = np.arange(n - k + 1)
    grams = span_hash(prefix, place, place + k)
    low, span, wide = grams, 1, window - k + 1
    while span < wide:
        step = min(span, wide - span)
        take = low[step:] < low[:-step]
        low = np.where(take, low[step:], low[:-step])
        place = np.where(take, place[step:], place[:-step])
        span += step
    counts = np.maximum(sizes - window + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    at = place[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    first, last, at = start[new], start[np.append(new[1:], len(start)) - 1], at[new]
    context = span_hash(prefix, first, last + window) + ((at - first) * 131 + last - first).astype(U64) * U64(0x9E3779B97F4A7C15)
    shift = U64(64 - ANCHOR_BITS)
    return row[new], first, last, mix(grams[at]) >> shift, mix(context) >> shift


def key_of(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(anchor) + context)


def _ids(col: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in col.to_pylist()], dtype=np.int64)


def _parts(ids: np.ndarray, parts: int) -> np.ndarray:
    u = ids.view(U64)
    return ((u ^ (u >> U64(16)) ^ (u >> U64(32))).view(np.int64) % parts).astype(np.int64)


def _part_column(parts: int) -> F.Column:
    """_parts() on the column id."""
    u = F.coalesce(F.col("id"), F.lit(NO_ID))
    return F.pmod(u.bitwiseXOR(F.shiftrightunsigned(u, 16)).bitwiseXOR(F.shiftrightunsigned(u, 32)), F.lit(parts)).cast("int")


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values; nothing for no values."""
    if len(sorted_values):
        cut = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))).tolist()
        yield from zip(cut, [*cut[1:], len(sorted_values)], strict=True)


def _dealt(where: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Columns as bytes by the values of where."""
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [c[order] for c in columns]
    for a, b in _runs(where):
        yield int(where[a]), [c[a:b].tobytes() for c in columns]


POSTINGS = "bucket int, ids binary, anchors binary, contexts binary, known_ids binary, known_keys binary"


def postings(docs: DataFrame, window: int, k: int, buckets: int) -> DataFrame:
    """Step 1: docs (id, text)."""
    bits = buckets.bit_length() - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            names = _ids(batch.column(0))
            found = []
            for i, j in blocks(off):
                row, _, _, anchor, context = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], window, k)
                found.append((names[row + i], anchor, context))
            ids, anchor, context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (names[:0], names[:0].view(U64), names[:0].view(U64))
            order = np.lexsort((ids, context, anchor))
            ids, anchor, context = ids[order], anchor[order], context[order]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))) if len(ids) else np.zeros(0, bool)
            least = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))] if len(ids) else ids
            later = ids > least
            known = ids[later], key_of(anchor[later], context[later])
            out: list[list] = [[], [], [], [], [], []]

            def add(*values) -> None:
                for col, v in zip(out, values, strict=True):
                    col.append(v)

            for b, (i8, a8, c8) in _dealt((anchor[new] >> U64(ANCHOR_BITS - bits)).astype(np.int64) if bits else np.zeros(int(new.sum()), np.int64), ids[new], anchor[new], context[new]):
                a, c, i = np.frombuffer(a8, U64), np.frombuffer(c8, U64), np.frombuffer(i8, np.int64)
                base = int(i.min())
                narrow = int(i.max()) - base < 1 << 32
                packed = np.array([base, narrow], np.int64).tobytes() + ((i - base).astype(np.uint32) if narrow else i).tobytes()
                add(b, packed, _pack48(a), _pack48(c), None, None)
            for b, (i8, k8) in _dealt(_parts(known[0], buckets), *known):
                add(b, None, None, None, i8, k8)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "ids", "anchors", "contexts", "known_ids", "known_keys"])

    return docs.mapInArrow(each, POSTINGS)


def _pack48(x: np.ndarray) -> bytes:
    return (x & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> U64(32)).astype(np.uint16).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(U64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(U64) << U64(32)


def _unpack_ids(raw: bytes) -> np.ndarray:
    base, narrow = np.frombuffer(raw, np.int64, 2)
    return np.frombuffer(raw, np.uint32, -1, 16).astype(np.int64) + base if narrow else np.frombuffer(raw, np.int64, -1, 16)


VERDICTS = "part int, ask boolean, ids binary, keys binary, masks binary"


def settle(rows: DataFrame, parts: int) -> DataFrame:
    """Step 2: verdicts on whole contexts (ask false) and contexts whose bytes are needed (ask true), by part of the id."""

    def one(group: pa.Table) -> pa.Table:
        got = group.to_pydict()
        some = [n for n, x in enumerate(got["ids"]) if x is not None]
        cat = lambda values, kind: np.concatenate(values) if values else np.zeros(0, kind)
        ids = cat([_unpack_ids(got["ids"][n]) for n in some], np.int64)
        anchor, context = (cat([_unpack48(got[c][n]) for n in some], U64) for c in ("anchors", "contexts"))
        gone_ids = [np.frombuffer(x, np.int64) for x in got["known_ids"] if x is not None]
        gone_keys = [np.frombuffer(x, U64) for x in got["known_keys"] if x is not None]
        ask_ids, ask_keys = np.zeros(0, np.int64), np.zeros(0, U64)
        if len(ids):
            order = np.lexsort((ids, context, anchor))
            ids, anchor, context = ids[order], anchor[order], context[order]
            at = np.arange(len(ids))
            new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            new = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
            least = ids[np.maximum.accumulate(np.where(new, at, 0))]
            later = ids > least
            gone_ids.append(ids[later])
            gone_keys.append(key_of(anchor[later], context[later]))
            heads = np.flatnonzero(new)  # one for each context
            starts = np.searchsorted(heads, np.flatnonzero(new_anchor))
            mixed = np.minimum.reduceat(ids[heads], starts) < np.maximum.reduceat(ids[heads], starts)
            several = np.repeat(mixed, np.diff(np.append(starts, len(heads))))
            asked = heads[several]
            ask_ids, ask_keys = ids[asked], key_of(anchor[asked], context[asked])
        out: list[tuple] = []
        gone = cat(gone_ids, np.int64)
        for p, (i8, k8) in _dealt(_parts(gone, parts), gone, cat(gone_keys, U64)):
            out.append((p, False, i8, k8, None))
        for p, (i8, k8) in _dealt(_parts(ask_ids, parts), ask_ids, ask_keys):
            out.append((p, True, i8, k8, None))
        return _verdict_table(out)

    return rows.groupBy("bucket").applyInArrow(one, VERDICTS)


def _verdict_table(rows: list[tuple]) -> pa.Table:
    kinds = pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "ask", "ids", "keys", "masks"), cols, kinds, strict=True)})


def _own(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(U64)) ^ keys)


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of (id, key) and their masks, repeats united."""
    owns, masks = [], []
    for i8, k8, m8 in zip(*(table.column(c).to_pylist() for c in ("ids", "keys", "masks")), strict=True):
        own = _own(np.frombuffer(i8, np.int64), np.frombuffer(k8, U64))
        owns.append(own)
        masks.append(np.full(len(own), 0xFFFFFFFFFFFFFFFF, U64) if m8 is None else np.frombuffer(m8, U64))
    own, mask = (np.concatenate([np.zeros(0, U64), *x]) for x in (owns, masks))
    if not len(own):
        return own, mask
    order = np.argsort(own, kind="stable")
    own, mask = own[order], mask[order]
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[cut], np.bitwise_or.reduceat(mask, cut)


CONTEXTS = "bucket int, ids binary, keys binary, counts binary, bytes binary"


def contexts(dealt: DataFrame, asks: DataFrame, window: int, k: int, buckets: int) -> DataFrame:
    """The bytes of the contexts asked for, to the anchors' buckets. dealt: id, text, part."""
    bits = buckets.bit_length() - 1

    def one(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        own, _ = _asked(wanted)
        out: list[list] = [[], [], [], [], []]
        if len(own) and docs.num_rows:
            data, off = byte_view(docs.column("text"))
            names = _ids(docs.column("id"))
            held: list[tuple] = []
            for i, j in blocks(off):
                part = data[off[i] : off[j]]
                row, first, last, anchor, context = anchors(part, off[i : j + 1] - off[i], window, k)
                key = key_of(anchor, context)
                mine = _own(names[row + i], key)
                hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine)
                _, at = np.unique(mine[hit], return_index=True)
                hit = hit[at]
                bucket = (anchor[hit] >> U64(ANCHOR_BITS - bits)).astype(np.int64) if bits else np.zeros(len(hit), np.int64)
                held.append((bucket, names[row[hit] + i], key[hit], (last - first + 1)[hit], [part[a : b + window].tobytes() for a, b in zip(first[hit].tolist(), last[hit].tolist(), strict=True)]))
            bucket, ids, key, counts = (np.concatenate([h[c] for h in held]) for c in range(4))
            texts = np.array([t for h in held for t in h[4]], dtype=object)
            order = np.argsort(bucket, kind="stable")
            for a, b in _runs(bucket[order]):
                some = order[a:b]
                for col, v in zip(out, (int(bucket[some[0]]), ids[some].tobytes(), key[some].tobytes(), counts[some].astype(np.uint8).tobytes(), b"".join(texts[some])), strict=True):
                    col.append(v)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "ids", "keys", "counts", "bytes"), out, (pa.int32(), *[pa.binary()] * 4), strict=True)})

    return dealt.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(one, CONTEXTS)


class LevelFamily:
    """Sorted windows with the smallest document of each, in levels of falling size; equal sizes merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def merge(windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in order, their smallest documents, and the place of each window in them.

        Sorted runs behind each other are merged in linear time.
        """
        order = np.argsort(windows, kind="stable")
        held = windows[order]
        new = np.concatenate(([True], held[1:] != held[:-1]))
        cut = np.flatnonzero(new)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return held[cut], np.minimum.reduceat(docs[order], cut), place

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch; the smallest document of each of its windows, in the batch or in any level."""
        if not len(windows):
            return docs
        own, least, place = self.merge(windows, docs)
        found = least
        for held, theirs in self.levels:
            _, low, where = self.merge(np.concatenate((held, own)), np.concatenate((theirs, least)))
            found = np.minimum(found, low[where[len(held) :]])
        level = own, least
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            old = self.levels.pop()
            level = self.merge(np.concatenate((old[0], level[0])), np.concatenate((old[1], level[1])))[:2]
        self.levels.append(level)
        return found[place]


def compare(asked: DataFrame, window: int, parts: int, batch: int = 16_384) -> DataFrame:
    """Step 3: verdicts on single windows: bit i of a mask is the context's window i."""

    def one(group: pa.Table) -> pa.Table:
        got = group.to_pydict()
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in got["ids"]])
        keys = np.concatenate([np.frombuffer(x, U64) for x in got["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in got["counts"]]).astype(np.int64)
        data = np.frombuffer(b"".join(got["bytes"]), np.uint8)
        begin = np.cumsum(counts + window - 1) - (counts + window - 1)
        every = np.lib.stride_tricks.sliding_window_view(data, window)
        masks, order, family = np.zeros(len(ids), U64), np.argsort(ids, kind="stable"), LevelFamily()
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            n = counts[some]
            bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(begin[some], n) + bit
            windows = np.ascontiguousarray(every[start]).view(f"S{window}").reshape(-1)
            docs = np.repeat(ids[some], n)
            earlier = family.add(windows, docs) < docs
            np.bitwise_or.at(masks, np.repeat(some, n)[earlier], U64(1) << bit[earlier].astype(U64))
        hit = np.flatnonzero(masks)
        return _verdict_table([(p, False, *cols) for p, cols in _dealt(_parts(ids[hit], parts), ids[hit], keys[hit], masks[hit])])

    return asked.groupBy("bucket").applyInArrow(one, VERDICTS)


def cut(dealt: DataFrame, verdicts: DataFrame, window: int, k: int, keep_text: bool) -> DataFrame:
    """Step 4: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""

    def one(docs: pa.Table, found: pa.Table) -> pa.Table:
        own, masks = _asked(found)
        names = docs.column("id").to_pylist()
        ids = _ids(docs.column("id"))
        data, off = byte_view(docs.column("text"))
        out: list[list] = [[], [], [], [], []]
        for i, j in blocks(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            gone = np.zeros(len(part), dtype=bool)
            if len(own):
                row, first, last, anchor, context = anchors(part, o, window, k)
                mine = _own(ids[row + i], key_of(anchor, context))
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                mask = np.where(own[at] == mine, masks[at], U64(0))
                edge = np.zeros(len(part) + 1, dtype=np.int64)
                whole = np.flatnonzero(mask == ~U64(0))
                np.add.at(edge, first[whole], 1)
                np.add.at(edge, last[whole] + window, -1)
                some = np.flatnonzero((mask != 0) & (mask != ~U64(0)))
                for bit in range(window - k + 1):
                    start = first[some] + bit
                    start = start[((mask[some] >> U64(bit)) & U64(1) > 0) & (start <= last[some])]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            rise = gone & ~np.concatenate(([False], gone[:-1]))
            starts = o[:-1][np.diff(o) > 0]
            rise[starts] = gone[starts]
            runs = np.concatenate(([0], np.cumsum(rise)))
            for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                kept = part[a:b] if total[a] == total[b] else part[a:b][~gone[a:b]]
                for col, v in zip(out, (b - a, int(total[b] - total[a]), int(runs[b] - runs[a]), hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes() if keep_text else None), strict=True):
                    col.append(v)
        return pa.table({"id": pa.array(names, pa.int64()), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "kept": pa.array(out[4], pa.binary())})

    return dealt.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(one, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _text_bytes(docs: DataFrame) -> int:
    """Bytes of the input by the planner's statistics, or counted where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 20, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept)."""
    if not 0 < k < window <= k + 63:
        raise ValueError("k must be below the window and at most 63 bytes shorter")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = _text_bytes(source)
    buckets = 1 << max(3, min(24, math.ceil(math.log2(max(1, size / (8 << 20))))))
    parts = max(8, math.ceil(size / (6 << 20)))
    verdicts = stash(settle(postings(source, window, k, buckets), parts), "verdicts")

    dealt = source.select("id", "text", _part_column(parts).alias("part"))
    asked = contexts(dealt, verdicts.where("ask"), window, k, buckets)
    whole = verdicts.where("not ask").unionByName(compare(asked, window, parts))
    out = cut(dealt, whole, window, k, keep_text)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
