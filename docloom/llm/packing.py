"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are encoded, an end id is added, and only documents longer than a sequence are cut. Full pieces are sequences
of their own. The other pieces are dealt at random into groups of about `group_items`; each group is packed by `islands`
populations that evolve apart, one task each, and pass their best individual on to the next island after every epoch.
Crossover injects whole well-filled bins of one parent into the other, takes the bins that share a document out, and
best-fits the displaced documents, longest first. The best individual of any island packs the group.

Null text counts as empty (one end id); rows that repeat an id, or have none, are packed each for itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .encode import MemoEncoder, as_uint32

Bins = list[list[int]]


def fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """Put items, in the given order, each into the fullest bin that still takes it; bins is changed and returned."""
    slots: dict[int, list[int]] = {}
    mask = 0
    for b, held in enumerate(bins):
        space = capacity - sum(sizes[i] for i in held)
        if space:
            slots.setdefault(space, []).append(b)
            mask |= 1 << space
    for i in items:
        size = sizes[i]
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = slots[space]
            b = own.pop()
            if not own:
                mask ^= 1 << space
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        space -= size
        if space:
            slots.setdefault(space, []).append(b)
            mask |= 1 << space
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins; larger is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(sizes: list[int], left: Bins, right: Bins, capacity: int, rng: random.Random, well: float = 0.995) -> Bins:
    """Child of left with whole well-filled bins of right."""
    good = [b for b in right if sum(sizes[i] for i in b) >= well * capacity]
    taken = rng.sample(good, k=rng.randint(1, len(good))) if good else []
    inside = {i for b in taken for i in b}
    kept, loose = [], []
    for b in left:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in inside]
    poor = sorted(range(len(kept)), key=lambda b: sum(sizes[i] for i in kept[b]))[: 2 + len(kept) // 50]
    for b in sorted(poor, reverse=True):  # the emptiest bins are dissolved too
        loose += kept.pop(b)
    loose.sort(key=lambda i: -sizes[i])
    return fit(sizes, loose, [*map(list, taken), *kept], capacity)


def seed(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Bins:
    """Best fit with sizes in falling order, disturbed by noise."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    return fit(sizes, order, [], capacity)


def evolve(sizes: list[int], population: list[Bins], capacity: int, generations: int, rng: random.Random, keep: int) -> list[Bins]:
    least = math.ceil(sum(sizes) / capacity)
    rank = lambda p: sorted(p, key=lambda x: fitness(sizes, x, capacity), reverse=True)[:keep]
    population = rank(population)
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        children = []
        for _ in range(keep):
            a, b = rng.sample(population, 2) if len(population) > 1 else (population[0], seed(sizes, capacity, rng, 0.1))
            children.append(cross(sizes, a, b, capacity, rng))
        population = rank(population + children)
    return population


def _to_bytes(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for b, held in enumerate(bins):
        out[held] = b
    return out.tobytes()


def _from_bytes(raw: bytes) -> Bins:
    where = np.frombuffer(raw, "<i4")
    bins: Bins = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, b in enumerate(where.tolist()):
        bins[b].append(i)
    return bins


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (unique)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = MemoEncoder.of(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], [], []]
                for name, raw in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = as_uint32(raw, end_id)
                    for k in range(0, len(ids), capacity):
                        own = ids[k : k + capacity]
                        for col, v in zip(out, (name, k // capacity, k, len(own), zlib.crc32(own.data), row), strict=True):
                            col.append(v)
                        row += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


STATE = "grp long, island int, sizes binary, population array<binary>"


def pack(items: DataFrame, capacity: int = 4096, group_items: int = 8192, islands: int = 2, epochs: int = 2, generations: int = 3, population: int = 4) -> DataFrame:
    """items with `length` (1 to capacity) and a unique `row`: the same rows with sequence_id and offset."""
    single = items.where(F.col("length") == capacity)
    loose = items.where(F.col("length") < capacity)
    n = loose.count()
    groups = max(1, round(n / group_items))
    loose = loose.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def start(group: pa.Table) -> pa.Table:
        sizes = group.sort_by("row").column("length").to_numpy().astype("<i4").tobytes()
        grp = group.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([grp] * islands, pa.int64()), "island": pa.array(range(islands), pa.int32()), "sizes": pa.array([sizes] * islands, pa.binary()), "population": pa.array([[]] * islands, pa.list_(pa.binary()))})

    def epoch(number: int):
        def one(rows: pa.Table) -> pa.Table:
            got = rows.to_pylist()
            grp, island = got[0]["grp"], got[0]["island"]
            raw = next(r["sizes"] for r in got if r["sizes"] is not None)
            sizes = np.frombuffer(raw, "<i4").tolist()
            rng = random.Random(f"{grp}/{island}/{number}")
            own = [_from_bytes(p) for r in sorted(got, key=lambda r: r["sizes"] is None) for p in r["population"]]
            if not number:
                own = [seed(sizes, capacity, rng, 0.02 * (island + k * islands)) for k in range(population)]
            own = [_to_bytes(p, len(sizes)) for p in evolve(sizes, own, capacity, generations, rng, population)]
            return pa.table({"grp": pa.array([grp] * 2, pa.int64()), "island": pa.array([island, (island + 1) % islands], pa.int32()), "sizes": pa.array([raw, None], pa.binary()), "population": pa.array([own, own[:1]], pa.list_(pa.binary()))})

        return one

    state = loose.select("grp", "row", "length").groupBy("grp").applyInArrow(start, STATE)
    # little data, much work: left to itself the planner puts all islands into one task
    tasks = min(groups * islands, max(2 * items.sparkSession.sparkContext.defaultParallelism, groups * islands // 16))
    for k in range(epochs):
        state = state.repartition(tasks, "grp", "island").groupBy("grp", "island").applyInArrow(epoch(k), STATE)

    def finish(rows: pa.Table, best: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        sizes = rows.column("length").to_pylist()
        found = [_from_bytes(p) for r in best.column("population").to_pylist() for p in r]
        bins = max(found, key=lambda b: fitness(sizes, b, capacity))
        where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, held in enumerate(bins):
            at = 0
            for i in held:
                where[i], offset[i] = b, at
                at += sizes[i]
        grp = rows.column("grp")[0].as_py() if rows.num_rows else 0
        return rows.drop(["grp"]).append_column("sequence_id", pa.array(grp * (1 << 32) + where)).append_column("offset", pa.array(offset))

    names = [f.name for f in items.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    packed = loose.select(*names, "grp").groupBy("grp").cogroup(state.groupBy("grp")).applyInArrow(finish, schema)
    return packed.unionByName(single.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = stash(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    return pack(items, capacity, **options).drop("row")
