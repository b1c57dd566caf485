"""Shared pieces: shared-folder scratch tables, vectorised word and window hashes over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch
from ..sources.scratch import drop_scratch, scratch_path

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; returns a new array."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
#: Bytes of words: digits, ASCII letters and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19), base, dtype=U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.large_binary(), pa.large_string()):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """P with P[i] the weighted sum of the first i bytes, for span_hash."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more than rows). offsets[0] must be 0."""
    n = len(data)
    inside = WORD_BYTE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    here = np.zeros(n + 1, dtype=bool)
    here[:n] = inside
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the rows' first words."""
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix_hash(data, lower=True), starts, ends), first


def running(h: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... hashes, modulo 2 ** 64."""
    return np.concatenate((np.zeros(1, dtype=U64), np.cumsum(h, dtype=U64)))


_MULTIPLIERS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, over row ends too."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += words[j : j + n] * _MULTIPLIERS[j]
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of each row and the rows' offsets in them. A row of fewer words, but not none, is one shingle."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate(([0], np.cumsum(counts)))
    grams = gram_hash(words, k)
    where = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], counts)
    out = grams[np.minimum(where, max(len(grams) - 1, 0))] if len(grams) else np.zeros(off[-1], dtype=U64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[off[i]] = mix(np.sum(words[first[i] : first[i + 1]] * _MULTIPLIERS[32 : 32 + n[i]], dtype=U64)[None])[0]
    return out, off


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, frees its shuffle files."""
    small_batches(df.sparkSession)
    return scratch.stash(df, name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts: the default of 10,000 rows takes hundreds of megabytes in a worker. A set value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["U64", "blocks", "byte_view", "drop_scratch", "gram_hash", "mix", "prefix_hash", "running", "scratch_path", "shingles", "small_batches", "span_hash", "stash", "table", "word_hashes", "word_spans"]
