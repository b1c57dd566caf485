"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and for every single byte, so that any
word can be cut). The probability of a word sums over all its segmentations by a forward pass; a text's score is the
product over its words, so each distinct word of a block is worked out once. The piece probabilities come from
expectation maximisation: expected counts of each piece over all segmentations of the training words.

At most `max_docs` documents of each language train the model, with their whole texts: those with the least hashes of id
and text. Their words are counted by the executors; the driver gets the distinct ones. Every language of the rows that
may be learned from is learned, and every piece of the vocabulary is used. Every document is scored whole. Words are
lower-cased runs of letters, digits and non-ASCII characters; one longer than 28 bytes, as in writing without spaces, is
learned and scored in parts of about 28, cut between characters, of which only the first begins a word. Texts that are null
or have no letter get `und` and score 0, as does everything where nothing could be learned. Ties go to the first language
in order. Repeated rows are scored each for itself; rows without an id train nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, U64, blocks, byte_view, mix, prefix_hash, span_hash, stash, word_spans
from .toxicity import held_out

WIDTH = 32
#: Bytes of a part of a long word; with up to three more of a character it fits.
STEP = WIDTH - 4
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = U64(0x9FB21C651E98DF25)


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a SentencePiece model as bytes, lower-cased, with one underscore for the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).lower().replace("▁", "_").encode()
            if 0 < len(piece) <= WIDTH:
                out.add(piece)
    return sorted(out)


class Lattice:
    """Finds pieces at all places of many words at once."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.array([self._hash(p) for p in pieces], dtype=U64)
        self.order = np.argsort(hashes)
        self.hashes, self.n, self.longest = hashes[self.order], len(pieces), max(map(len, pieces))

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = np.zeros(1, dtype=U64)
        for b in piece:
            h = (h + _BYTE[b]) * _MULTIPLIER
        return int(mix(h)[0])

    def edges(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words' indexes, piece ids) in order of start. words: [n, WIDTH] bytes, sorted by falling length."""
        for start in range(int(lengths[0]) if len(lengths) else 0):
            h = np.zeros(len(words), dtype=U64)
            for end in range(start + 1, min(start + self.longest, int(lengths[0])) + 1):
                n = int(np.searchsorted(-lengths, -end, "right"))  # words of at least `end` bytes
                h = (h[:n] + _BYTE[words[:n, end - 1]]) * _MULTIPLIER
                m = mix(h)
                at = np.minimum(np.searchsorted(self.hashes, m), self.n - 1)
                hit = np.flatnonzero(self.hashes[at] == m)
                if len(hit):
                    yield start, end, hit, self.order[at[hit]]


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of words, long ones in parts, and whether a part lies inside a word."""
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    k = np.maximum(ends - starts - 1, 0) // STEP + 1
    part = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    inner = part > 0
    if inner.any():
        row, final, starts = np.repeat(row, k), np.repeat(ends, k), np.repeat(starts, k) + part * STEP
        for _ in range(3):  # back to the first byte of a character
            starts = starts - (inner & (data[starts] & 0xC0 == 0x80))
        ends = np.where(np.append(inner[1:], False), np.append(starts[1:], 0), final)
    return row, starts, ends, inner


def word_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of WIDTH bytes, behind an underscore where they begin."""
    lead = ~inner
    at = np.clip((starts - lead)[:, None] + np.arange(WIDTH), 0, max(len(data) - 1, 0))
    out = _LOWER[data[at]]
    out[lead, 0] = 95
    return out, ends - starts + lead


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct word, the word of each place, and how often each occurs."""
    h = span_hash(prefix_hash(data, lower=True), starts, ends) + inner.astype(U64)
    _, at, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return at, back, n


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], log_or_p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, log_or_p
        self._lattice: Lattice | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lattice": None}

    @property
    def lattice(self) -> Lattice:
        self._lattice = self._lattice or Lattice(self.pieces)
        return self._lattice

    def words(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        order = np.argsort(-lengths, kind="stable")
        rows = max(500, 80_000 // max(1, len(self.languages)))
        for i in range(0, len(order), rows):
            part = order[i : i + rows]
            out[part] = np.log(np.maximum(forward(self.lattice, self.p, words[part], lengths[part])[0], 1e-300))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihood of each row in each language."""
        row, starts, ends, inner = word_parts(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(starts):
            return out
        at, back, _ = distinct_words(data, starts, ends, inner)
        each = self.words(*word_matrix(data, starts[at], ends[at], inner[at]))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(row, each[back, k], len(out))
        return out


def forward(lattice: Lattice, p: np.ndarray, words: np.ndarray, lengths: np.ndarray, edges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each word in each language, and the forward sums [word, place, language]. Longest words first."""
    alpha = np.zeros((WIDTH + 1, len(words), p.shape[1]))
    alpha[0] = 1
    for edge in lattice.edges(words, lengths):
        start, end, hit, piece = edge
        alpha[end][hit] += alpha[start][hit] * p[piece]
        if edges is not None:
            edges.append(edge)
    return alpha[lengths, np.arange(len(words))], alpha


def fit(counted: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 3, floor: float = 0.02) -> Model:
    """Expectation maximisation for each language over its words (an underscore before those that begin one) and their counts."""
    languages = sorted(counted)
    lattice = Lattice(pieces)
    p = np.zeros((len(pieces), len(languages)))
    start = np.array([300.0 ** -1 / 4 ** max(0, 3 - len(x)) for x in pieces])
    for k, lang in enumerate(languages):
        found = sorted(counted[lang].items(), key=lambda x: (-len(x[0]), x[0]))  # longest first
        lengths, n = np.array([len(w) for w, _ in found], dtype=np.int64), np.array([c for _, c in found], dtype=np.int64)
        words = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w, _ in found), np.uint8).reshape(-1, WIDTH)
        if not found:
            p[:, k] = start / start.sum()
            continue
        own = (start / start.sum())[:, None]
        for _ in range(rounds):
            count = np.full(len(pieces), floor)
            for i in range(0, len(words), 10_000):
                w, size, c = words[i : i + 10_000], lengths[i : i + 10_000], n[i : i + 10_000]
                edges: list = []
                total, alpha = forward(lattice, own, w, size, edges)
                beta = np.zeros((WIDTH + 1, len(w)))
                beta[size, np.arange(len(w))] = c / np.maximum(total[:, 0], 1e-300)
                for begin, end, hit, piece in reversed(edges):
                    share = own[piece, 0] * beta[end][hit]
                    count += np.bincount(piece, alpha[begin][hit, 0] * share, len(pieces))
                    beta[begin][hit] += share
            own = (count / count.sum())[:, None]
        p[:, k] = own[:, 0]
    return Model(languages, pieces, p)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of rows (lang, text) with their numbers."""
    for batch in batches:
        data, off = byte_view(batch.column(1))
        for i, j in blocks(off):
            part = data[off[i] : off[j]]
            row, starts, ends, inner = word_parts(part, off[i : j + 1] - off[i])
            names, lang = np.unique(np.array(batch.column(0).slice(i, j - i).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for k, name in enumerate(names.tolist()):
                own = np.flatnonzero(lang[row] == k)
                if len(own):
                    at, _, n = distinct_words(part, starts[own], ends[own], inner[own])
                    words, lengths = word_matrix(part, starts[own][at], ends[own][at], inner[own][at])
                    raw = words.tobytes()
                    held = [raw[x : x + m] for x, m in zip(range(0, len(raw), WIDTH), lengths.tolist(), strict=True)]
                    yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(held, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 400) -> Model:
    """Fit on documents with a language that are not held out: a bounded sample of each language by a hash of id and text."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = stash(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.xxhash64("id", "text")
    share = F.pmod(place, F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * (1.3 * max_docs + 50))  # enough of them, and few to order
    few = known.join(sizes, "lang").where(share).select("lang", "id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", "text"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= max_docs).select("lang", "text")
    counted: dict[str, dict[bytes, int]] = {r.lang: {} for r in sizes.collect()}
    for r in sample.mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counted[r.lang][bytes(r.word)] = r.n
    return fit(counted, vocabulary(vocabulary_path))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (posterior of the language under a flat prior)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            data, off = byte_view(batch.column(1))
            for i, j in blocks(off, 1 << 22):
                letters = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).slice(i, j - i).to_pylist()], dtype=bool)
                if m.languages:
                    s = m.scores(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    best = np.argmax(s, axis=1)
                    sure = 1 / np.exp(np.clip(s - s.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                else:
                    best, sure = np.zeros(j - i, dtype=int), np.zeros(j - i)
                    letters[:] = False
                best, sure = np.where(letters, best, -1), np.where(letters, sure, 0.0)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(sure, pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(each, "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
