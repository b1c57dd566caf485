"""Exact deduplication: a static binary-fuse filter per bucket of an immutable snapshot screens the digests of a new batch.

The snapshot is a folder of digests by bucket and one filter for each bucket (save_snapshot), written once and read by
every later batch. Digests that a filter rejects are new for certain and are only grouped among themselves; digests that it lets through
join the snapshot's exact bucket, where all 32 bytes of the SHA-256 are compared. Both sides are pre-aggregated to one
row per digest first, so a text with a third of all copies is one row in every bucket.

Texts are equal when they are identical after deleting space, tab, LF, VT, FF and CR. Of equal texts, the row with the
most code points stays, then the smallest id. Null text counts as empty; empty texts are equal to each other; a null
id loses every tie; of rows that repeat an id each goes by its own text, and one of equal rows stays; an empty table
gives an empty result; other columns of the input are ignored, but for those named in `also`. Texts are read whole,
whatever their length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, scratch_path, stash

WHITE = b" \t\n\v\f\r"


class BinaryFuse:
    """3-wise binary fuse filter with 16-bit fingerprints over distinct 64-bit keys; no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U64(seed))
        first = ((h >> U64(32)) * U64(segment * segments)) >> U64(32)
        low = U64(segment - 1)
        second = (first + U64(segment)) ^ ((h >> U64(18)) & low)
        third = (first + U64(2 * segment)) ^ (h & low)
        return np.stack((first, second, third)).astype(np.int64), (mix(h) >> U64(48)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) * n
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 200):
            places, prints = cls._places(keys, seed * 0x51ED2701, segment, segments)
            size = segment * (segments + 2)
            count = np.bincount(places.ravel(), minlength=size)
            owner = np.zeros(size, dtype=np.int64)  # the xor of the keys in a slot
            for row in places:
                np.bitwise_xor.at(owner, row, np.arange(n))
            layers, left, ready = [], n, np.flatnonzero(count == 1)
            while len(ready):
                key, at = np.unique(owner[ready], return_index=True)
                layers.append((key, ready[at]))
                left -= len(key)
                touched = places[:, key].ravel()
                np.subtract.at(count, touched, 1)
                np.bitwise_xor.at(owner, touched, np.tile(key, 3))
                touched = np.unique(touched)
                ready = touched[count[touched] == 1]
            if not left:
                table = np.zeros(size, dtype=np.uint16)
                for key, slot in reversed(layers):
                    a, b, c = table[places[:, key]]
                    table[slot] = a ^ b ^ c ^ prints[key] ^ table[slot]
                return cls(seed * 0x51ED2701, segment, segments, table)
            segments += 1 + segments // 20
        raise RuntimeError("no binary fuse filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys, self.seed, self.segment, self.segments)
        a, b, c = self.table[places]
        return (a ^ b ^ c) == prints


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, row (unique once written), digest (SHA-256 of the text without white space), the code points of the text, also_0, also_1, ..."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = [hashlib.sha256((t or "").encode().translate(None, WHITE)).digest() for t in texts]
            own = [pa.array(np.arange(row, row + len(texts))), pa.array(sums, pa.binary()), pa.array([len(t or "") for t in texts], pa.int64())]
            row += len(texts)
            yield pa.record_batch([batch.column(0), *own, *batch.columns[2:]], ["id", "row", "digest", "n_chars", *batch.schema.names[2:]])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"also_{n}") for n, c in enumerate(also)))
    names = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(each, f"id long, row long, digest binary, n_chars long{names}")


def classes(rows: DataFrame) -> DataFrame:
    """One row per digest: its number of rows, and the order key of the row that stays."""
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("low"), F.bitwise_not("row").alias("place")))  # ~x falls as x rises, for every long
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _keys(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in col.to_pylist()), dtype="<u8") if len(col) else np.zeros(0, dtype=U64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """snapshot: digest and bucket. One binary-fuse filter per bucket."""

    def build(group: pa.Table) -> pa.Table:
        f = BinaryFuse.build(_keys(group.column("digest")))
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "prints": pa.array([f.table.tobytes()], pa.binary())})

    return snapshot.groupBy("bucket").applyInArrow(build, "bucket long, seed long, segment long, segments long, prints binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """batch (digest, bucket, n, best) with `maybe`: false where the digest is not in the snapshot."""

    def look(rows: pa.Table, found: pa.Table) -> pa.Table:
        maybe = np.zeros(rows.num_rows, dtype=bool)
        if found.num_rows and rows.num_rows:
            f = found.to_pylist()[0]
            maybe = BinaryFuse(f["seed"], f["segment"], f["segments"], np.frombuffer(f["prints"], np.uint16)).contains(_keys(rows.column("digest")))
        return rows.append_column("maybe", pa.array(maybe))

    schema = "digest binary, n long, best struct<n_chars:long,low:long,place:long>, bucket long, maybe boolean"
    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(look, schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def save_snapshot(found: DataFrame, path: str, bucket_rows: int = 100_000) -> None:
    """Write a classes() frame as an immutable snapshot: its digests with their buckets, and a filter for each bucket of about bucket_rows digests."""
    digests_path = f"{path}/digests"
    found.write.parquet(f"{path}/classes")
    held = found.sparkSession.read.parquet(f"{path}/classes")
    held.withColumn("bucket", _bucket(max(1, math.ceil(held.count() / bucket_rows)))).write.parquet(digests_path)
    build_filters(found.sparkSession.read.parquet(digests_path).select("digest", "bucket")).write.parquet(f"{path}/filters")


def merge(path: str, batch: DataFrame) -> DataFrame:
    """Classes of the snapshot at path and of the batch (a classes() frame) together."""
    spark = batch.sparkSession
    old, filters = spark.read.parquet(f"{path}/digests"), spark.read.parquet(f"{path}/filters")
    buckets = (old.agg(F.max("bucket")).first()[0] or 0) + 1
    new = batch.select("digest", "n", "best", _bucket(buckets).alias("bucket"))
    screened = stash(screen(new, filters), "screened")
    positive = screened.where("maybe").select("digest", "n", "best")
    known = old.select("digest", "n", "best").unionByName(positive).groupBy("digest").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    return known.unionByName(screened.where("not maybe").select("digest", "n", "best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", since: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and the columns in `also`.

    Rows with an id below `since` (default: the middle of the ids) become the immutable snapshot, the rest is the new
    batch; where the line is drawn changes the work, never the result.
    """
    rows = stash(digests(docs, id_col, text_col, also), "digests")
    if since is None:
        ends = rows.agg(F.min("id"), F.max("id")).first()
        since = ends[0] + (ends[1] - ends[0]) // 2 if ends[0] is not None else 0
    older = F.coalesce(F.col("id") < since, F.lit(False))
    snapshot = scratch_path(docs.sparkSession, "snapshot")
    save_snapshot(classes(rows.where(older)), snapshot)
    found = merge(snapshot, classes(rows.where(~older)))
    joined = rows.join(found, "digest")
    stays = F.col("row") == F.bitwise_not("best.place")
    carried = (F.col(f"also_{n}").alias(c) for n, c in enumerate(also))
    return joined.select(F.col("id").alias(id_col), F.bitwise_not("best.low").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *carried)
