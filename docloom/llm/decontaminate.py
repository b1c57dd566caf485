"""Benchmark decontamination by winnowing.

Word k-grams are hashed and the minimum of every sliding window of w hashes is kept (the rightmost of ties), so any
shared run of k + w - 1 words holds a k-gram that both sides kept. Items with fewer words are one window: all their words
at once are the k-gram, and every position of a document is kept for it.

1. The fingerprints of the items become a table (fingerprint, item) and a bit map of bounded size.
2. Every document is winnowed; the fingerprints that the bit map knows are written with it.
3. They are joined with the items' fingerprints, which gives the items each document may hold.
4. A document meets these items, `chunk` at a time: each shared fingerprint is extended word by word to both sides; a run
   counts if it has `window` words.

Null or wordless texts have no words and no hits; an item without words has no window; items with equal texts are one text
with several ids; a repeated item id counts once; the words of an item with a null id are hit, but no id is listed or
counted for it. Rows that repeat a document id, or have none, are judged each for itself. Other columns are ignored, but
for those named in `also`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, byte_view, gram_hash, mix, stash, word_hashes


def winnow(grams: np.ndarray, first: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of w grams inside each row; a row of fewer grams has one window.

    Row i has counts[i] grams from first[i] on; after them follow at least w - 1 places that belong to no row.
    """
    n, some = len(grams), counts > 0
    if not n or not some.any():
        return np.zeros(0, dtype=np.int64)
    first, counts = first[some], counts[some]
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[first] += 1
    edge[first + counts] -= 1
    inside = np.cumsum(edge[:n]) > 0
    low = np.where(inside, grams, ~U64(0))
    source, place = low.copy(), np.arange(n)
    for j in range(1, min(w, n)):
        take = source[j:] <= low[: n - j]
        low[: n - j] = np.where(take, source[j:], low[: n - j])
        place[: n - j] = np.where(take & inside[j:], np.arange(j, n), place[: n - j])
    starts = np.flatnonzero(inside)
    return np.unique(place[starts[starts <= np.repeat(first + np.maximum(counts - w, 0), counts)]])


class Items:
    """Fingerprints of some benchmark items; ids holds the list of ids of each text."""

    def __init__(self, ids: list, texts: list, window: int = 13, k: int = 7):
        self.window, self.k, self.ids = window, k, ids
        data, off = byte_view(pa.array(texts, pa.string()))
        self.words, self.first = word_hashes(data, off)
        n = np.diff(self.first)
        grams = gram_hash(self.words, k)
        long = n >= window
        counts = np.where(long, n - k + 1, 0)
        kept = winnow(grams, self.first[:-1], counts, window - k + 1)
        order = np.argsort(grams[kept], kind="stable")
        self.prints, self.places = grams[kept][order], kept[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted(set(n[(n > 0) & ~long].tolist())):
            rows = np.flatnonzero(n == size)
            g = gram_hash(self.words, size)[self.first[rows]]
            order = np.argsort(g, kind="stable")
            self.short[size] = g[order], rows[order]

    @staticmethod
    def _pairs(grams: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of equal values of grams and of sorted prints."""
        if not len(prints) or not len(grams):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lo = np.searchsorted(prints, grams, "left")
        some = np.flatnonzero(prints[np.minimum(lo, len(prints) - 1)] == grams)
        lo = lo[some]
        n = np.searchsorted(prints, grams[some], "right") - lo
        return np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item index, first word, end word) of each run that covers a window; runs may repeat."""
        n = np.diff(first)
        grams = gram_hash(words, self.k)
        kept = winnow(grams, first[:-1], np.maximum(n - self.k + 1, 0), self.window - self.k + 1) if len(self.prints) else np.zeros(0, dtype=np.int64)
        a, b = self._pairs(grams[kept], self.prints)
        done: dict[tuple[int, int, int], int] = {}
        for at, place in zip(kept[a].tolist(), self.places[b].tolist(), strict=True):
            row = int(np.searchsorted(first, at, "right")) - 1
            item = int(np.searchsorted(self.first, place, "right")) - 1
            if at < done.get((row, item, at - place), 0):
                continue
            lo = min(at - first[row], place - self.first[item])
            hi = min(first[row + 1] - at, self.first[item + 1] - place)
            back = words[at - lo : at][::-1] == self.words[place - lo : place][::-1]
            on = words[at : at + hi] == self.words[place : place + hi]
            start = at - (lo if back.all() else int(np.argmin(back)))
            end = at + (hi if on.all() else int(np.argmin(on)))
            done[row, item, at - place] = end
            if end - start >= self.window:
                yield row, item, int(start), int(end)
        for size, (prints, rows) in self.short.items():
            grams = gram_hash(words, size)
            a, b = self._pairs(grams, prints)
            for at, item in zip(a.tolist(), rows[b].tolist(), strict=True):
                row = int(np.searchsorted(first, at, "right")) - 1
                place = self.first[item]
                if at + size <= first[row + 1] and (words[at : at + size] == self.words[place : place + size]).all():
                    yield row, item, at, at + size


def fingerprints(words: np.ndarray, first: np.ndarray, window: int, k: int, short: list[int], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the kept k-grams of rows of at least `window` words, and of the grams of the sizes in short: all of them, or (whole) of rows that have just as many words."""
    n = np.diff(first)
    grams = gram_hash(words, k)
    at = winnow(grams, first[:-1], np.where(n >= window, n - k + 1, 0), window - k + 1)
    rows, prints = [np.searchsorted(first, at, "right") - 1], [grams[at]]
    for size in short:
        g = gram_hash(words, size)
        some = np.flatnonzero(n == size) if whole else np.flatnonzero(n >= size)
        counts = n[some] - size + 1
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[some], counts)
        rows.append(np.repeat(some, counts))
        prints.append(mix(g[at] + U64(size)))
    return np.concatenate(rows), np.concatenate(prints)


def item_prints(items: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """print, item of each fingerprint of items (item, ids, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                rows, prints = fingerprints(words, first, window, k, short, True)
                yield pa.record_batch([pa.array(prints.view(np.int64)), batch.column(0).take(pa.array(rows + i))], ["print", "item"])

    return items.select("item", "text").mapInArrow(each, "print long, item long").distinct()


SLICES = 64


def bit_map(prints: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, those of the prints set: its size is bounded whatever their number."""
    inner = bits - 6

    def add(group: pa.Table) -> pa.Table:
        held = np.zeros(1 << inner, dtype=bool)
        held[group.column("slot").to_numpy()] = True
        return pa.table({"slice": group.column("slice").slice(0, 1), "map": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    slot = F.shiftrightunsigned("print", 64 - bits)
    slots = prints.select(F.shiftright(slot, inner).cast("int").alias("slice"), slot.bitwiseAND(F.lit((1 << inner) - 1)).cast("int").alias("slot")).distinct()
    out = np.zeros((SLICES, 1 << inner >> 3), dtype=np.uint8)
    for r in slots.groupBy("slice").applyInArrow(add, "slice int, map binary").collect():
        out[r["slice"]] = np.frombuffer(r["map"], np.uint8)
    return out.reshape(-1)


def screen(docs: DataFrame, known, bits: int, window: int, k: int, short: list[int]) -> DataFrame:
    """docs (id, text) with row (unique once written), n_words and the prints that the bit map knows; the text only where there is one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = known.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = byte_view(batch.column(1))
            n_words, prints = [], []
            for i, j in blocks(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n_words.append(np.diff(first))
                rows, found = fingerprints(words, first, window, k, short, False)
                slot = (found >> U64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero(held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                own: list[set] = [set() for _ in range(j - i)]
                for r, x in zip(rows[hit].tolist(), found[hit].view(np.int64).tolist(), strict=True):
                    own[r].add(x)
                prints += [sorted(x) for x in own]
            some = pa.array([bool(p) for p in prints], pa.bool_())
            rest = [pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), pa.array(prints, pa.list_(pa.int64()))]
            row += batch.num_rows
            text = pc.if_else(some, batch.column(1), pa.scalar(None, batch.column(1).type))
            yield pa.record_batch([batch.column(0), text, *batch.columns[2:], *rest], schema=pa.schema([*(pa.field(f.name, f.type) for f in batch.schema), ("row", pa.int64()), ("n_words", pa.int64()), ("prints", pa.list_(pa.int64()))]))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(each, f"{names}, row long, n_words long, prints array<long>")


def find_hits(asked: DataFrame, window: int, k: int) -> DataFrame:
    """asked: row, text, items (structs of ids and text). Per row: hit word runs as packed int64 pairs, ids of items found."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for own in batch.column(2).to_pylist():
                held.update((x["text"], x["ids"]) for x in own)
            items = Items(list(held.values()), list(held), window, k)
            data, off = byte_view(batch.column(1))
            runs, names = [], []
            for i, j in blocks(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                spans: list[list] = [[] for _ in range(j - i)]
                found: list[set] = [set() for _ in range(j - i)]
                for row, item, a, b in items.hits(words, first):
                    spans[row].append((a - first[row], b - first[row]))
                    found[row].update(items.ids[item])
                runs += [np.array(s, dtype=np.int64).tobytes() for s in spans]
                names += [sorted(f) for f in found]
            yield pa.record_batch([batch.column(0), pa.array(runs, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["row", "runs", "items"])

    return asked.select("row", "text", "items").mapInArrow(each, "row long, runs binary, items array<string>")


def covered(runs: bytes) -> int:
    """Words inside the union of the packed runs."""
    end = total = 0
    for a, b in sorted(map(tuple, np.frombuffer(runs, np.int64).reshape(-1, 2).tolist())):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, k: int = 7, chunk: int = 128, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more are hit), and the columns in `also`."""
    if not 0 < window - k + 1 <= k <= 32:
        raise ValueError("k must be over half the window and at most 32")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    items = items.groupBy("text").agg(F.collect_set("id").alias("ids")).select(F.monotonically_increasing_id().alias("item"), "ids", "text")
    items = stash(items, "items")
    sizes = items.mapInArrow(lambda batches: _sizes(batches, window), "size int").distinct().collect()  # below the window each
    short = sorted(r["size"] for r in sizes)
    prints = stash(item_prints(items, window, k, short), "prints")
    bits = min(28, max(16, math.ceil(math.log2(4096 * max(1, prints.count())))))
    known = spark.sparkContext.broadcast(bit_map(prints, bits))
    carried = [F.col(c).alias(f"also_{n}") for n, c in enumerate(also)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carried)
    rows = stash(screen(source, known, bits, window, k, short), "screened")
    pairs = rows.where(F.size("prints") > 0).select("row", F.explode("prints").alias("print")).join(prints, "print").select("row", "item").distinct()
    part = F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")
    parts = pairs.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    held = pairs.join(parts, "row").select("row", part, "item").join(items, "item").groupBy("row", "part").agg(F.collect_list(F.struct("ids", "text")).alias("items"))
    asked = rows.where(F.size("prints") > 0).select("row", "text").join(held, "row")
    joined = F.unhex(F.array_join(F.transform(F.collect_list("runs"), F.hex), ""))
    hits = find_hits(asked, window, k).groupBy("row").agg(joined.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = rows.select("id", "row", "n_words", *(f"also_{n}" for n in range(len(also)))).join(hits, "row", "left").drop("row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_words").to_pylist()
            hit = [covered(x or b"") for x in batch.column("runs").to_pylist()]
            names = batch.column("items").to_pylist()
            sums = [hashlib.sha256(",".join(x or []).encode()).hexdigest() for x in names]
            bad = [h > 0 and 20 * h >= m for h, m in zip(hit, n, strict=True)]
            found = [batch.column("id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x or []) for x in names], pa.int64()), pa.array(sums, pa.string()), pa.array(bad, pa.bool_())]
            yield pa.record_batch([*found, *(batch.column(f"also_{n}") for n in range(len(also)))], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *also])

    names = "".join(f", `{c}` {hits.schema[f'also_{n}'].dataType.simpleString()}" for n, c in enumerate(also))
    return hits.mapInArrow(finish, f"`{id_col}` long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean{names}")


def _sizes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Numbers of words of items (item, ids, text) that are shorter than the window, but not empty."""
    for batch in batches:
        data, off = byte_view(batch.column(2))
        n = np.diff(word_hashes(data[: off[-1]], off)[1]) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(np.unique(n[(n > 0) & (n < window)]), pa.int32())], ["size"])
