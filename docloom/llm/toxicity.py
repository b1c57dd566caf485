"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence is a run of text between full stops, question or exclamation marks and line ends. Its features are its
lower-cased words and their first four and five characters, hashed. A linear model over the telling ones gives each
sentence a probability, 0 without any; a document is toxic with 1 - prod(1 - p). Training follows the gradient of the document likelihood, so that blame goes
to the sentences that explain a label; locate() returns them.

At most `max_docs` labelled documents train the model, with their whole texts: those with the least hashes of id and
text (a documented bound on the rows that one task trains on; the driver gets the model alone). Every document is scored whole. Null and empty texts have
no sentence and get the score of an empty product, 0. Without any labelled document of both kinds, every score is 0.
Repeated rows are scored each for itself; labels that contradict each other count as toxic; rows without an id train
nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, byte_view, mix, prefix_hash, span_hash, stash, word_spans

BITS = 20
_BREAK = np.zeros(256, dtype=np.int64)
_BREAK[list(b".!?\n\r")] = 1


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features [3, words], the sentence of each word (numbered from 0), and the sentences' rows."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = prefix_hash(data, lower=True)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = breaks[starts] + row * (len(data) + 1)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    sentence = np.cumsum(new) - 1
    out = np.empty((3, len(starts)), np.int64)
    for k, size in enumerate((None, 4, 5)):
        stop = ends if size is None else np.minimum(ends, starts + size)
        h = span_hash(prefix, starts, stop)
        out[k] = (mix(h + U64(k)) >> U64(64 - BITS)).astype(np.int64)
    return out, sentence, row[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability and row of each sentence."""
        f, sentence, rows = features(data, offsets)
        if not len(rows):
            return np.zeros(0), rows
        w = self.weights[f]
        told = np.bincount(sentence, (w != 0).any(axis=0), len(rows)) > 0
        return np.where(told, _sigmoid(np.bincount(sentence, w.sum(axis=0), len(rows)) + self.bias), 0.0), rows

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, rows = self.sentences(data, offsets)
        return 1 - np.exp(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-12)), len(offsets) - 1))


def telling(a: np.ndarray, b: np.ndarray, n: float, m: float, least: float) -> np.ndarray:
    """Features with a higher document frequency in toxic documents (a of n against b of m), by a log-likelihood ratio of at least `least`."""
    part = lambda k, of, share: k * np.log(np.maximum(k / of, 1e-12) / np.maximum(share, 1e-12)) + (of - k) * np.log(np.maximum(1 - k / of, 1e-12) / np.maximum(1 - share, 1e-12))
    share = (a + b) / (n + m)
    return (2 * (part(a, n, share) + part(b, m, share)) >= least) & (a / n > b / m)


def fit(texts: list[str], labels: list[int], rounds: int = 80, rate: float = 0.3, decay: float = 0.1, least: float = 11.0, chunk: int = 250) -> Model:
    """Full-batch Adagrad on the noisy-or likelihood over the telling features, which a first pass over the texts finds."""
    y = np.array(labels, dtype=np.float64)
    weights = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(weights, -30.0)

    def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(texts), chunk):
            data, off = byte_view(pa.array(texts[i : i + chunk], pa.string()))
            yield i, *features(data[: off[-1]], off)

    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i, f, sentence, rows in parts():
        seen = np.unique((rows[sentence] << BITS) + f)
        toxic = y[i + (seen >> BITS)]
        a += np.bincount(seen & ((1 << BITS) - 1), toxic, 1 << BITS)
        b += np.bincount(seen & ((1 << BITS) - 1), 1 - toxic, 1 << BITS)
    known = telling(a, b, y.sum(), len(y) - y.sum(), least)
    ids = np.flatnonzero(known)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    docs: list[np.ndarray] = []
    total = 0
    for i, f, sentence, rows in parts():  # only sentences with a telling feature matter
        use = known[f]
        some, own = np.unique(np.broadcast_to(sentence, f.shape)[use], return_inverse=True)
        found.append((np.searchsorted(ids, f[use]), own + total))
        docs.append(rows[some] + i)
        total += len(some)
    inverse, where = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.concatenate(docs)
    w, gain, bias, bias_gain = np.zeros(len(ids)), np.full(len(ids), 1e-8), -2.0, 1e-8
    for _ in range(rounds):
        p = _sigmoid(np.bincount(where, w[inverse], len(rows)) + bias)
        miss = np.exp(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        blame = np.where(y[rows] > 0, -miss[rows] / np.maximum(1 - miss[rows], 1e-9), 1.0) * p / len(y)
        g = np.bincount(inverse, blame[where], len(ids)) + decay / len(y) * w
        gain += g * g
        w -= rate * g / np.sqrt(gain)
        b = blame.sum()
        bias_gain += b * b
        bias -= rate * b / np.sqrt(bias_gain)
    weights[ids] = w
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 6000) -> Model:
    """Fit on labelled documents that are not held out: a bounded sample by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = stash(known.orderBy(F.xxhash64("id"), "id").limit(max_docs), "labels")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # chosen has max_docs rows at most; where ids repeat, as many of their texts train
    rows = source.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(max_docs).select("id", "text", F.col("y").cast("int").alias("y"))
    return learned(rows)


def learned(rows: DataFrame) -> Model:
    """fit() of rows (id, text, y) in one task: only the bias and the weights that are not 0 come to the driver, whatever the texts hold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, int]] = []
        for batch in batches:
            ids, texts, y = (c.to_pylist() for c in batch.columns)
            held += zip(ids, (t or "" for t in texts), y, strict=True)
        held.sort(key=lambda r: r[:2])
        model = fit([r[1] for r in held], [r[2] for r in held])
        at = np.flatnonzero(model.weights)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(model.weights[at], pa.float32()), pa.nulls(len(at), pa.float64())], ["at", "weight", "bias"])
        yield pa.record_batch([pa.array([None], pa.int32()), pa.array([None], pa.float32()), pa.array([model.bias], pa.float64())], ["at", "weight", "bias"])

    weights, bias = np.zeros(1 << BITS, np.float32), -30.0  # as fit() has them without rows
    for r in rows.coalesce(1).mapInArrow(each, "at int, weight float, bias double").collect():
        if r.at is None:
            bias = r.bias
        else:
            weights[r.at] = r.weight
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            out = [shared.value.scores(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
            s = np.clip(np.concatenate(out) if out else np.zeros(0), 0, 1)
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(each, "id long, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(at))
            out = [shared.value.scores(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
            yield batch.filter(pa.array((np.concatenate(out) if out else np.zeros(0)) < 0.5))

    return docs.mapInArrow(each, docs.schema)


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Sentences with a probability of at least `least`: id, sentence (number in the text), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off):
                p, rows = shared.value.sentences(data[off[i] : off[j]], off[i : j + 1] - off[i])
                number = np.arange(len(rows)) - np.searchsorted(rows, rows)
                hit = np.flatnonzero(p >= least)
                yield pa.record_batch([batch.column(0).take(pa.array(rows[hit] + i)), pa.array(number[hit], pa.int64()), pa.array(p[hit], pa.float64())], ["id", "sentence", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(each, "id long, sentence long, score double").withColumnRenamed("id", id_col)
