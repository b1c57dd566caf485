"""Token ids in directly addressable codes.

Each id is cut into chunks of 8 bits from the low end. Level 0 holds the first chunk of every id and a bitmap that says
which ids go on; level 1 holds the second chunk of those only, and so on. A rank directory (ones before each 512 bits)
turns a position of one level into its position in the next, so any token is read with a few lookups and no block is
decoded.

A store is a folder of Parquet files whose rows are segments: (part, seg, before, n_docs, n_tokens, image), before being
the ids of the part ahead of the segment. An image is
self-contained: magic "DAC1", the numbers of levels, ids and documents, the document directory (ids and starts in the
segment), then the levels. A segment ends with the document that brings it to `segment_tokens` ids; a document is never
split over two, and one of more ids is a segment with what came before it. Images (about 140 kB by default), pages and
row groups are small, so that the arrays of a task that writes or reads a store don't grow with its part. Parts follow
the order of the document ids. Null text counts as empty, and an empty text still has its end id; rows that repeat an
id follow each other, ordered by text; null ids come first; an empty table makes an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .encode import MemoEncoder, as_uint32

MAGIC = b"DAC1"
RANK_BITS = 512
SCHEMA = "part int, seg int, before long, n_docs int, n_tokens long, image binary"
#: By default Parquet looks at sizes after 100 rows only, so all images of a part are one page; arrays of that size make a JVM's heap grow.
LAYOUT = {"parquet.page.size.row.check.min": "1", "parquet.page.size": str(1 << 18), "parquet.block.size": str(1 << 20), "parquet.enable.dictionary#image": "false"}
#: Rows of a columnar batch of texts.
ROWS = 64


def pack(ids: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Image of a segment: ids of all its documents, document ids, and where each document starts."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8))
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(axis=1)
        ranks = np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()) if more.any() else ((rest & 255).astype(np.uint8).tobytes(), b"", b""))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<IQI", len(levels), len(ids), len(docs))
    sizes = b"".join(struct.pack("<QQQ", *map(len, x)) for x in levels)
    return head + sizes + docs.astype("<i8").tobytes() + starts.astype("<i8").tobytes() + b"".join(b"".join(x) for x in levels)


class Segment:
    """Random access to the ids of an image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.n_tokens, n_docs = struct.unpack_from("<IQI", image, 4)
        at = 20
        sizes = [struct.unpack_from("<QQQ", image, at + 24 * i) for i in range(n_levels)]
        at += 24 * n_levels
        self.docs = np.frombuffer(image, "<i8", n_docs, at)
        self.starts = np.frombuffer(image, "<i8", n_docs, at + 8 * n_docs)
        at += 16 * n_docs
        self.levels = []
        for a, b, c in sizes:
            self.levels.append((np.frombuffer(image, np.uint8, a, at), np.frombuffer(image, np.uint8, b, at + a), np.frombuffer(image, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def get(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places, without decoding their neighbours."""
        at = np.asarray(places, dtype=np.int64)
        out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * depth)
            if not len(bits):
                break
            on = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            who, at = who[on], at[on]
            block = at // RANK_BITS
            width = RANK_BITS // 8
            window = bits.reshape(-1, width)[block]
            keep = np.unpackbits(window, axis=1, bitorder="little") if len(block) else np.zeros((0, RANK_BITS), np.uint8)
            before = (keep * (np.arange(RANK_BITS) < (at % RANK_BITS)[:, None])).sum(axis=1, dtype=np.int64)
            at = ranks[block].astype(np.int64) + before
        return out

    def all(self) -> np.ndarray:
        """All ids in order: a scan of the levels."""
        out, who = np.zeros(self.n_tokens, np.uint32), None
        for depth, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * depth)
            if who is None:
                out |= part
            else:
                out[who] |= part
            if not len(bits):
                break
            on = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            who = on if who is None else who[on]
        return out

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.n_tokens
        return self.get(np.arange(self.starts[k], end))


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Columnar batches of at most ROWS rows: the arrays that hold the texts of the default of 4096 double up to tens of megabytes."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1 << 16) -> None:
    """Encode the texts and write them to path in ascending order of the ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg, before = MemoEncoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        raws: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u2").tobytes()

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(r) // 2 for r in raws], dtype=np.int64)
            ids = np.frombuffer(b"".join(raws), "<u2")
            doc_ids = np.array([np.iinfo(np.int64).min if x is None else x for x in names], dtype=np.int64)
            image = pack(ids, doc_ids, np.cumsum(lengths) - lengths)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "seg", "before", "n_docs", "n_tokens", "image"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                for name, raw in zip(piece.column(0).to_pylist(), encoder.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    names.append(name)
                    raws.append(raw + end)
                    size += len(raws[-1]) // 2
                    if size >= segment_tokens:
                        yield segment()
                        names, raws, size, seg, before = [], [], 0, seg + 1, before + size
        if names:
            yield segment()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    with short_batches(docs.sparkSession):
        ordered.mapInArrow(each, SCHEMA).write.options(**LAYOUT).parquet(path)


def part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part: one number for each task that wrote the store, which is what the driver knows of tasks anyway."""
    out, total = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        out[r.part] = total
        total += r.n
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    starts = part_starts(segments)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*batch.columns, strict=True):
                s = Segment(image.as_py())
                ids, base = s.all().astype("<u4"), starts[part.as_py()] + before.as_py()
                ends = np.append(s.starts[1:], s.n_tokens)
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(s.starts.tolist(), ends.tolist(), strict=True)]
                none = s.docs == np.iinfo(np.int64).min
                yield pa.record_batch([pa.array(s.docs, pa.int64(), mask=none), pa.array(s.starts + base, pa.int64()), pa.array(ends - s.starts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "before", "image").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a store in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id, id_col, text_col)
    return read_store(docs.sparkSession, path)


__all__ = ["Segment", "as_uint32", "encode_documents", "pack", "part_starts", "read_store", "write_store"]
