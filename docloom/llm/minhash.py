"""Near-duplicate detection by BagMinHash: weighted-Jaccard signatures of the multisets of word shingles.

The weight of a shingle is its number of occurrences, discretised at 1, 2, 4, 8, ...: each interval between two levels
has a Poisson process of points (time, register, place in the interval) that depends on the shingle alone; the points
at places up to the weight count, and a register keeps the earliest time. Points are made in order of time up to a bound
that follows from the total weight, and again with twice the bound for the few documents with an empty register.

Texts with the same multiset collapse to one representative first. Signatures are cut into bands; representatives that
share a band are candidates. In a band bucket of up to `all_pairs` members every pair is one; in a larger bucket each
member is a candidate with the smallest member, of the bucket and of its parts that share further bands. Candidates are
verified on the multisets of their whole texts; classes are the connected components of the verified links, named by
their smallest id. Larger buckets whose members are then in several classes are looked at again: first each member with
the one that shares the most bands with others, then all members of such buckets by an exact join of their multisets
(set_join), between classes only. So no pair that shares a band is left out: it is verified, or the filters of that join
rule it out, or it is in one class already.

With 32 bands of 5 registers, a pair at the threshold 0.8 shares a band with a probability over 0.99999. Texts without
words (null, empty) are classes of their own; texts of fewer words than a shingle are one shingle. Rows are told apart by
a number that is written once, so rows that repeat an id, or have none, are placed each by its own text; null ids come
last in a class and name it only where all its ids are null. One row of each class is kept, also of equal rows. An empty
table gives an empty result; other columns are ignored, but for those named in `also`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from .common import U64, blocks, byte_view, mix, running, shingles, stash, word_hashes
from .components import components, extended

BANDS, ROWS = 32, 5


def multisets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in order, their counts, and the rows' offsets in them."""
    words, first = word_hashes(data, offsets)
    s, off = shingles(words, first, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(off))
    bits = max(1, int(len(offsets)).bit_length())
    key = np.sort((row.astype(U64) << U64(64 - bits)) | (s >> U64(bits)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    rows = (key[new] >> U64(64 - bits)).astype(np.int64)
    # the same width of a shingle for every block, whatever its number of rows
    return ((key[new] << U64(bits)) >> U64(24)), counts, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(shingle: np.ndarray, counts: np.ndarray, offsets: np.ndarray, registers: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """[rows, registers] earliest times; infinite for rows without shingles."""
    n = len(offsets) - 1
    out = np.full((n, registers), np.inf)
    row = np.repeat(np.arange(n), np.diff(offsets))
    weight = np.bincount(row, counts, n)
    todo, bound = np.flatnonzero(weight > 0), (np.log(registers) + 3) / np.maximum(weight, 1) / 1.0
    level_rows, level_shingles, level_counts, lows, spans = [row], [shingle], [counts], [np.zeros(len(row), np.int64)], [np.ones(len(row), np.int64)]
    low = 1
    while True:
        more = np.flatnonzero(counts > low)
        if not len(more):
            break
        level_rows.append(row[more])
        level_shingles.append(shingle[more])
        level_counts.append(counts[more])
        lows.append(np.full(len(more), low))
        spans.append(np.full(len(more), low))
        low *= 2
    rows, base, most = np.concatenate(level_rows), mix(np.concatenate(level_shingles) + U64(seed)), np.concatenate(level_counts)
    lo, span = np.concatenate(lows), np.concatenate(spans)
    base = mix(base + lo.astype(U64) * U64(0x9E3779B97F4A7C15))
    wanted = np.zeros(n, dtype=bool)
    while len(todo):
        wanted[:] = False
        wanted[todo] = True
        at = np.flatnonzero(wanted[rows])
        time, step = np.zeros(len(at)), 0
        while len(at):
            step += 1
            h = mix(base[at] + U64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            time = time - np.log(((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span[at]
            live = time <= bound[rows[at]] * registers
            at, time, h = at[live], time[live], h[live]
            g = mix(h + U64(7))
            inside = np.flatnonzero(lo[at] + 1 + ((g >> U64(32)) % span[at].astype(U64)).astype(np.int64) <= most[at])
            register = ((g[inside] & U64(0xFFFFFFFF)) % U64(registers)).astype(np.int64)
            np.minimum.at(out.reshape(-1), rows[at[inside]] * registers + register, time[inside])
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        bound[todo] *= 2
        out[todo] = np.inf
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """[rows, BANDS] keys."""
    parts = np.ascontiguousarray(signature).view(U64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key + parts[:, :, j])
    return key


def profile(source: DataFrame, k: int) -> DataFrame:
    """source: id, text and others. In place of the text: row (unique once written), n (shingles), c1, c2 (hash of the multiset), keys (band keys, packed)."""
    rest = [f for f in source.schema.fields if f.name not in ("id", "text")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off, 1 << 19):
                s, c, o = multisets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.bincount(np.repeat(np.arange(j - i), np.diff(o)), c, j - i).astype(np.int64)
                at = running(mix(s + c.astype(U64) * U64(0x9E3779B97F4A7C15)))
                also = running(mix(mix(s) ^ c.astype(U64)))
                sums = [x[o[1:]] - x[o[:-1]] for x in (at, also)]
                raw = bands(signatures(s, c, o)).tobytes()
                keys = [raw[x : x + 8 * BANDS] for x in range(0, len(raw), 8 * BANDS)]
                own = [pa.array(np.arange(row, row + j - i)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(keys, pa.binary())]
                row += j - i
                others = [batch.column(f.name).slice(i, j - i) for f in rest]
                yield pa.record_batch([batch.column(0).slice(i, j - i), *others, *own], ["id", *(f.name for f in rest), "row", "n", "c1", "c2", "keys"])

    names = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return source.select("id", "text", *(f.name for f in rest)).mapInArrow(each, f"id long{names}, row long, n long, c1 long, c2 long, keys binary")


def explode(reps: DataFrame, together: int = 1, reach: int = 1) -> DataFrame:
    """Per representative (id, n, keys): a row for each band key, or for each pair of bands up to `reach` apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = np.frombuffer(b"".join(part.column(2).to_pylist()), U64).reshape(-1, BANDS)
                if together == 2:
                    keys = np.concatenate([mix(keys + mix(np.roll(keys, -d, axis=1))) for d in range(1, reach + 1)], axis=1)
                where = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(where), part.column(1).take(where)], ["key", "id", "n"])

    return reps.select("id", "n", "keys").mapInArrow(each, "key long, id long, n long")


def stars(keyed: DataFrame, over: int = 1) -> DataFrame:
    """Candidates of each member with its bucket's smallest; buckets of more than `over` members."""
    tops = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("top")).where(F.col("m") > over)
    return keyed.join(tops, "key").select(F.col("top.id").alias("a"), F.col("top.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn"))


def fitting(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b, each once, whose sizes allow the threshold, with their shingles together."""
    fits = F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn")
    return pairs.where(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("an") + F.col("bn")).alias("n")).distinct()


def candidates(reps: DataFrame, threshold: float, all_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of representatives that share a band and whose sizes allow the threshold; the members of larger buckets."""
    keyed = explode(reps)
    tops = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = stash(keyed.join(tops, "key"), "bands")
    small = shared.where(F.col("m") <= all_pairs).select("key", "id", "n")
    pairs = small.select("key", F.col("id").alias("a"), F.col("n").alias("an")).join(small.select("key", F.col("id").alias("b"), F.col("n").alias("bn")), "key").where("a < b").drop("key")
    large = shared.where(F.col("m") > all_pairs)
    pairs = pairs.unionByName(stars(large.select("key", "id", "n")))
    members = reps.join(large.select("id").distinct(), "id", "left_semi")
    pairs = pairs.unionByName(stars(explode(members, 2, 3)))
    return fitting(pairs, threshold), large


def unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the buckets that reach into several classes, with their classes in a column root."""
    placed = large.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return placed.join(several.select("key"), "key", "left_semi")


def centred(still: DataFrame) -> DataFrame:
    """Candidates of each member with the one of its bucket that has the most company in all buckets, unless they are in one class."""
    company = still.groupBy("id").agg(F.sum("m").alias("company"))
    tops = still.join(company, "id").groupBy("key").agg(F.max(F.struct("company", "id", "n", "root")).alias("top"))
    sides = still.join(tops, "key").where(F.col("top.root") != F.col("root"))
    return sides.select(F.col("top.id").alias("a"), F.col("top.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn"))


def texts_of(source: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """asked: own, h (of representatives), id and more. The same with their texts, of source (id, h, text)."""
    own = F.coalesce(F.col("id"), F.lit(-1 << 63)).alias("own")
    texts = source.select(own, "h", "text").hint("merge")  # one plan at every size
    return texts.join(asked, ["own", "h"]).select("id", "text", *more)


def tokens(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of each block, and a token for each shingle and number of its occurrence with the rows' offsets: the multiset as a set."""
    data, off = byte_view(batch.column(column))
    for i, j in blocks(off, 1 << 19):
        s, c, o = multisets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        ends = np.cumsum(c)
        nth = np.arange(c.sum()) - np.repeat(ends - c, c)
        yield i, mix(np.repeat(s, c) + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), np.concatenate(([0], ends))[o]


def across(members: DataFrame, threshold: float, k: int, frequent: int = 1 << 16) -> DataFrame:
    """Links a, b between members (id, root, text) of different classes, by an exact join of their multisets."""
    table, total = set_join.word_ranks(members.select("text"), lambda batch: (t for _, t, _ in tokens(batch, 0, k)))
    ranks = members.sparkSession.sparkContext.broadcast(table)
    plan, buckets = set_join.Plan(threshold, frequent), max(16, total // 1_000_000)

    def ordered(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, token, off in tokens(batch, column, k):
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            yield i, token[np.lexsort((token, ranks.value[set_join.slot(token)], row))], off

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for i, token, off in ordered(batch, 2):
                    some = slice(i, i + len(off) - 1)
                    yield from set_join.postings(plan, ranks.value, buckets, token, off, ids[some], roots[some])

        yield from set_join.packed(found())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, token, off in ordered(batch, 1):
                raw, o = token.tobytes(), (8 * off).tolist()
                yield pa.record_batch([batch.column(0).slice(i, len(o) - 1), pa.array([raw[x:y] for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())], ["c1", "words"])

    def check(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        a, b = (pa.array(x) for x in set_join.links_of(group, plan, ranks.value, buckets))
        return pa.table({"a": group.column("c1").take(a), "b": group.column("c1").take(b)})

    rows = members.select("id", "root", "text").mapInArrow(keyed, "bucket long, postings binary")
    found = stash(set_join.candidates(rows, plan, set_join.CLASSED), "units")
    units = found.where("tile is null").unionByName(stash(set_join.tiled(found.where("tile is not null"), plan, set_join.CLASSED), "tiled"))
    asked = members.join(units.select(F.col("c1").alias("id")).distinct(), "id", "left_semi")
    held = asked.select("id", "text").mapInArrow(words, "c1 long, words binary")
    return units.select("gid", "at", "c1", "pairs").join(held, "c1").groupBy("gid").applyInArrow(check, "a long, b long")


def verify(pairs: DataFrame, chosen: Callable[[DataFrame], DataFrame], threshold: float, k: int, chunk: int = 128, weight: int = 500_000) -> DataFrame:
    """The pairs whose whole texts have a multiset Jaccard similarity of at least the threshold. chosen: adds the texts to a, part, id.

    Pairs are grouped by their first member, at most about `chunk` pairs or `weight` shingles to a group: a member with
    more is dealt out over several.
    """
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("n") / weight)).alias("parts")
    dealt = pairs.join(pairs.groupBy("a").agg(parts), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    sides = dealt.select("a", "part", F.col("b").alias("id")).unionByName(dealt.select("a", "part", F.col("a").alias("id")).distinct())
    rows = chosen(sides).repartition("a", "part").dropDuplicates(["a", "part", "id"])  # rows equal in id and text are one

    def check(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        ids = np.array(group.column("id").to_pylist(), dtype=np.int64)
        data, off = byte_view(group.column("text"))
        s, c, o = multisets(data[off[0] : off[-1]], off - off[0], k)
        hit: set[int] = set()
        for own in np.flatnonzero(ids == a):
            mine, n = s[o[own] : o[own + 1]], c[o[own] : o[own + 1]]
            for i in np.flatnonzero(ids != a):
                other, m = s[o[i] : o[i + 1]], c[o[i] : o[i + 1]]
                if len(mine) and len(other):
                    at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                    both = np.where(mine[at] == other, np.minimum(n[at], m), 0).sum()
                    if both >= threshold * (n.sum() + m.sum() - both) - 1e-9:
                        hit.add(int(ids[i]))
        return pa.table({"a": pa.array([a] * len(hit), pa.int64()), "b": pa.array(sorted(hit), pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5, all_pairs: int = 12, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), kept (for one row of each class), and the columns in `also`."""
    text, carried = F.col(text_col).cast("string"), [F.col(c).alias(f"also_{n}") for n, c in enumerate(also)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), *carried)
    rows = stash(profile(source, k), "profiles")
    known = rows.where("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "h")
    reps = known.groupBy("c1", "c2").agg(F.min(order).alias("own"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    reps = stash(reps.select("c1", "c2", "n", "keys", F.col("own.row").alias("id"), F.col("own.id").alias("name"), F.col("own.h").alias("h")), "reps")
    places = reps.select("id", F.coalesce(F.col("name"), F.lit(-1 << 63)).alias("own"), "h")
    pairs, large = candidates(reps.select("id", "n", "keys"), threshold, all_pairs)
    pairs = stash(pairs, "pairs")
    mark = F.lit(-1).cast("bigint")  # the members of large buckets come along, for later rounds
    more = large.select("id").distinct().select(F.lit(0).cast("bigint").alias("a"), mark.alias("part"), "id")
    held: list[DataFrame] = []

    def first(sides: DataFrame) -> DataFrame:
        held.append(stash(texts_of(source, sides.unionByName(more).join(places, "id"), "a", "part"), "texts"))
        return held[0].where("part >= 0")

    roots = components(stash(verify(pairs, first, threshold, k), "links"))
    texts = held[0].where("part < 0").select("id", "text")
    still = stash(unsettled(large, roots), "still")
    if not still.isEmpty():
        again = stash(fitting(centred(still), threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
        roots = extended(roots, stash(verify(again, lambda sides: sides.join(texts, "id"), threshold, k), "links"))
        ids = unsettled(still.select("key", "id", "n", "m"), roots).select("id", "root").distinct()
        members = stash(texts.join(ids, "id").dropDuplicates(["id"]), "members")
        if not members.isEmpty():
            roots = extended(roots, stash(across(members, threshold, k), "links"))
    placed = reps.select("c1", "c2", "id", "name").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "id")).alias("best"))
    classes = placed.join(best, "root").select("c1", "c2", F.col("best.name").alias("class"), F.col("best.id").alias("stays"))
    some = F.col("n") > 0
    out = rows.join(classes, ["c1", "c2"], "left").select(F.col("id").alias(id_col), F.when(some, F.col("class")).otherwise(F.col("id")).alias("class_id"), F.when(some, F.col("row") == F.col("stays")).otherwise(F.lit(True)).alias("kept"), *(F.col(f"also_{n}").alias(c) for n, c in enumerate(also)))
    return out
