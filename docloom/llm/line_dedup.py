"""Line deduplication by an exact set-similarity join.

A line (text between LF characters) is the set of its lower-cased words. Lines with equal sets are one class, with its
first occurrence in the order of (document, line). The sets are joined as set_join says: words by rarity, prefix,
positional and length filters, verification on the whole sets, taken again from the first line of each that takes part.
A bit table of a bounded size tells the tasks those lines; what it lets through besides goes in an exact join.

Sets of fewer than 1 / (1 - t) - 1 words can only equal another and take no part. Words are told apart by 64-bit hashes
and sets by 96-bit hashes of those.

A line is removed if an earlier line of the input has the same set or one with a similarity of t or more. Lines without
words stay and match nothing. Null text counts as empty; rows with a null id are placed before all others; rows that
repeat an id are one document for the order, the line numbers breaking ties; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, byte_view, mix, prefix_hash, running, span_hash, stash, word_spans
from .set_join import SLICES, Codebook, Plan, candidates, counted, homes, links_together, packed, postings, slot, tiled, unrolled

NULL_ID = -1 << 63
#: Bits of the table of lines, for a line and at most, and those set for its place and for its set there.
LINE_BITS, MOST_BITS, MARKS = 16, 1 << 28, 2


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each line of each row starts; an LF at the end of a row starts none."""
    if not len(data):
        return np.zeros(0, np.int64)
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[1:] = data == 10
    mark[offsets] = False
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, edges)
    return span_hash(prefix_hash(data, lower=True), starts, ends), first


def line_sets(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line, by rank and hash, the lines' offsets in them, the lines' rows and numbers."""
    starts = line_starts(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(row, row)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(1, np.int64), row, number
    word, first = _words(data, np.append(starts, len(data)))
    line = np.repeat(np.arange(len(starts)), np.diff(first))
    rank = ranks[slot(word)].astype(np.int64)
    key = line.astype(U64) << U64(40) | rank.astype(U64) << U64(32) | word >> U64(32)
    order = np.argsort(key)
    key, sorted_words = key[order], word[order]
    same = key[1:] == key[:-1]
    if len(starts) >= 1 << 24 or (same & (sorted_words[1:] != sorted_words[:-1])).any():  # the short key can't tell them apart
        order = np.lexsort((word, rank, line))
        sorted_words = word[order]
    line = line[order]
    new = np.concatenate(([True], (sorted_words[1:] != sorted_words[:-1]) | (line[1:] != line[:-1]))) if len(line) else np.zeros(0, bool)
    return sorted_words[new], np.searchsorted(line[new], np.arange(len(starts) + 1)), row, number


def set_hashes(words: np.ndarray, o: np.ndarray) -> np.ndarray:
    """64 bits of each set, as int64."""
    one, two = running(mix(words)), running(mix(words ^ U64(0x5851F42D4C957F2D)))
    return mix(mix(one[o[1:]] - one[o[:-1]]) + (two[o[1:]] - two[o[:-1]]) + np.diff(o).astype(U64)).view(np.int64)


def _text_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, off = byte_view(batch.column(0))
    for i, j in blocks(off):
        yield _words(data[off[i] : off[j]], off[i : j + 1] - off[i])[0]


def profile(docs: DataFrame, ranks) -> DataFrame:
    """Lines of docs (id, text): id, line, n (words), c1 (hash of the set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off):
                words, o, row, number = line_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], ranks.value)
                yield pa.record_batch([batch.column(0).take(pa.array(row + i)), pa.array(number, pa.int64()), pa.array(np.diff(o)), pa.array(set_hashes(words, o))], ["id", "line", "n", "c1"])

    return docs.select("id", "text").mapInArrow(each, "id long, line long, n long, c1 long")


def keyed(docs: DataFrame, ranks, plan: Plan, buckets: int, remember: int = 200_000) -> DataFrame:
    """Packed postings by bucket of their keys, of the sets of docs (text) that can match another.

    A task lists a set again only after `remember` others.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Words, sizes and hashes of the sets that are new to the task, about a million words at a time."""
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            data, off = byte_view(batch.column(0))
            for i, j in blocks(off):
                words, o, _, _ = line_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], ranks.value)
                c1 = set_hashes(words, o)
                fresh = np.zeros(len(c1), dtype=bool)
                for x, name in enumerate(c1.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[x] = True
                if len(seen) > remember:
                    seen.clear()
                n = np.diff(o)
                held.append((words[np.repeat(fresh, n)], n[fresh], c1[fresh]))
                size += len(held[-1][0])
                if size > 1 << 20:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, size = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(p for words, n, c1 in sets(batches) for p in postings(plan, ranks.value, buckets, words, np.concatenate(([0], np.cumsum(n))), c1))

    return docs.select("text").mapInArrow(each, "bucket long, postings binary")


def _marks(ids: pa.Array, line: np.ndarray, bits: int, c1: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The bits of places, or of sets in them; bits is a power of two."""
    own = pa.compute.fill_null(ids, NULL_ID).to_numpy(zero_copy_only=False)
    h = mix(mix(own.view(U64)) + line.view(U64))
    h = h if c1 is None else mix(h + mix(c1.view(U64)))
    step = mix(h) | U64(1)
    for k in range(MARKS):
        yield ((h + U64(k) * step) >> U64(64 - bits.bit_length() + 1)).astype(np.int64)


def _marked(table: np.ndarray, marks: Iterator[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) for at in marks])


def line_table(need: DataFrame) -> np.ndarray:
    """A bit table that holds every line of need (c1, first), and few others unless they are very many."""
    n = need.count()
    bits = min(max(1 << 16, 1 << (LINE_BITS * n).bit_length()), MOST_BITS)
    width = bits // SLICES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, ids, line = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            at = np.unique(np.concatenate([*_marks(ids, line, bits), *_marks(ids, line, bits, c1)]))
            cut = np.searchsorted(at, np.arange(SLICES + 1) * width)
            yield pa.record_batch([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([(at[x:y] % width).astype(np.uint32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["slice", "bits"])

    def add(group: pa.Table) -> pa.Table:
        own = np.zeros(width, dtype=bool)
        for raw in group.column("bits").to_pylist():
            own[np.frombuffer(raw, np.uint32)] = True
        return pa.table({"slice": group.column("slice").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((SLICES, width // 8), dtype=np.uint8)
    for r in need.select("c1", "first.id", "first.line").mapInArrow(each, "slice int, bits binary").groupBy("slice").applyInArrow(add, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def asked_words(need: DataFrame, docs: DataFrame, ranks, book, remember: int = 200_000) -> DataFrame:
    """c1, codes, others (see Codebook) of the sets in need (c1, first), from their first lines; a set may come twice, and a few others with them."""
    table = docs.sparkSession.sparkContext.broadcast(line_table(need))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 8 * len(table.value)
        seen: set[int] = set()
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off, 1 << 20):
                own, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts = line_starts(own, edges)
                row = np.searchsorted(edges, starts, "right") - 1
                number, ids = np.arange(len(starts)) - np.searchsorted(row, row), batch.column(0).take(pa.array(row + i))
                some = np.flatnonzero(_marked(table.value, _marks(ids, number, bits)))
                size = np.diff(np.append(starts, len(own)))
                take = np.zeros(len(starts), dtype=bool)
                take[some] = True
                words, o, _, _ = line_sets(own[np.repeat(take, size)], np.concatenate(([0], np.cumsum(size[some]))), ranks.value)
                c1 = set_hashes(words, o)
                hold = np.flatnonzero((np.diff(o) > 0) & _marked(table.value, _marks(ids.take(pa.array(some)), number[some], bits, c1)))
                if len(seen) > remember:
                    seen.clear()
                hold = [x for x, name in zip(hold.tolist(), c1[hold].tolist(), strict=True) if not (name in seen or seen.add(name))]
                take = np.zeros(len(some), dtype=bool)
                take[hold] = True
                n = np.diff(o)
                codes, others = book.value.encoded(words[np.repeat(take, n)], np.concatenate(([0], np.cumsum(n[hold]))))
                yield pa.record_batch([pa.array(c1[hold]), codes, others], ["c1", "codes", "others"])

    return docs.select("id", "text").mapInArrow(each, "c1 long, codes binary, others binary")


def verified(units: DataFrame, need: DataFrame, words: DataFrame, plan: Plan, ranks, book, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Per set with links, partial sums: c1, links, other (first of the earliest set linked); and the links: a, b.

    need: the sets (c1, first) that each dest of units takes.
    """

    def found(group: pa.Table, sets: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        sets = sets.take(pa.array(np.unique(sets.column("c1").to_numpy(), return_index=True)[1]))
        return sets, *links_together(group, sets, book.value, plan, ranks.value, buckets)

    def sums(group: pa.Table, sets: pa.Table) -> pa.Table:
        sets, a, b = found(group, sets)
        ids, line = (pa.compute.struct_field(sets.column("first"), [i]) for i in (0, 1))
        order = np.lexsort((line.to_numpy(), pa.compute.fill_null(ids, 0).to_numpy(), pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)))
        early = np.empty(len(order), dtype=np.int64)
        early[order] = np.arange(len(order))
        links = np.bincount(np.concatenate((a, b)), minlength=len(order))
        other = np.full(len(order), len(order))
        np.minimum.at(other, a, early[b])
        np.minimum.at(other, b, early[a])
        some = pa.array(np.flatnonzero(links))
        picked = pa.array(order[other[np.flatnonzero(links)]])
        return pa.table({"c1": sets.column("c1").take(some), "links": pa.array(links[links > 0], pa.int64()), "other": sets.column("first").take(picked)})

    def pairs(group: pa.Table, sets: pa.Table) -> pa.Table:
        sets, a, b = found(group, sets)
        return pa.table({"a": sets.column("c1").take(pa.array(a)), "b": sets.column("c1").take(pa.array(b))})

    held = words.hint("merge").join(need, "c1")
    both = units.groupBy("dest").cogroup(held.groupBy("dest"))
    return both.applyInArrow(sums, "c1 long, links long, other struct<id:long,line:long>"), both.applyInArrow(pairs, "a long, b long")


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, frequent: int = 1 << 16, tile: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (id, line, n, c1, removed, links), classes (c1, first, drop_first, links) and links (a, b of classes)."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    table, names, total = counted(source.select("text"), _text_words)
    ranks, book = (docs.sparkSession.sparkContext.broadcast(x) for x in (table, Codebook(names)))
    plan, buckets = Plan(threshold, frequent), max(16, total // 4_000_000)
    lines = stash(profile(source, ranks), "lines")
    place = F.struct("id", "line")
    sets = stash(lines.where("n > 0").groupBy("c1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("lines")), "sets")
    found = stash(candidates(keyed(source, ranks, plan, buckets), plan, tile=tile, by_sets=True), "units")
    units = found.where("tile is null").unionByName(stash(tiled(found.where("tile is not null"), plan, by_sets=True), "tiled"))
    units = stash(homes(units), "placed")
    need = unrolled(units, "dest").select("dest", "c1").distinct().hint("merge").join(sets.select("c1", "first"), "c1")
    need = stash(need, "need")
    sums, links = verified(units, need, asked_words(need, source, ranks, book), plan, ranks, book, buckets)
    linked = stash(sums.groupBy("c1").agg(F.sum("links").alias("links"), F.min("other").alias("other")), "linked")
    drop_first = F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("drop_first")
    classes = sets.hint("merge").join(linked, "c1", "left").select("c1", "first", "lines", drop_first, F.coalesce("links", F.lit(0)).alias("links"))
    some = classes.where("lines > 1 or links > 0").drop("lines")  # lines of all other sets stay and have no links
    judged = lines.select("id", "line", "n", "c1").hint("merge").join(some, "c1", "left")
    removed = F.coalesce(~place.eqNullSafe(F.col("first")) | F.col("drop_first"), F.lit(False)) & F.col("drop_first").isNotNull() & (F.col("n") > 0)
    return judged.select("id", "line", "n", "c1", removed.alias("removed"), F.coalesce("links", F.lit(0)).alias("links")), classes.drop("lines"), links


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, frequent: int = 1 << 16, tile: int = 2048) -> DataFrame:
    """Per document: id, class_id (smallest id with the same sequence of line sets), n_lines, n_removed, n_links.

    n_links: links of its distinct line sets to other line sets.
    """
    judged, _, _ = similar_lines(docs, id_col, text_col, threshold, frequent, tile)
    sign = F.xxhash64("c1", "line")
    sign = (F.sum(F.shiftright(sign, 32)).alias("high"), F.sum(sign.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    own = judged.groupBy("id", "c1").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("removed").cast("long")).alias("gone"), F.max("links").alias("links"), *sign)
    names = {"lines": "n_lines", "gone": "n_removed", "links": "n_links", "high": "high", "low": "low"}
    found = own.groupBy("id").agg(*(F.sum(x).alias(name) for x, name in names.items()))
    every = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    whole = stash(every.join(found, every["id"].eqNullSafe(found["id"]), "left").select(every["id"], *(F.coalesce(found[c], F.lit(0)).alias(c) for c in names.values())), "whole")
    smallest = whole.groupBy("high", "low", "n_lines").agg(F.min("id").alias("class_id"))
    return whole.join(smallest, ["high", "low", "n_lines"]).select(F.col("id").alias(id_col), "class_id", "n_lines", "n_removed", "n_links")
