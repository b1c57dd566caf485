"""Token ids of texts by a public tokenizer, with a memo of what each white-space separated piece encodes to.

The pre-tokenizers of the two vocabularies never join anything across a space that stands before a non-space, so the
ids of a text are the ids of the pieces between such spaces, one after another. A new piece goes through the tokenizers
library: one of Latin letters, with perhaps a punctuation mark behind it, straight to its BPE model (such a piece is one
pre-token, the mark another), any other through the whole tokenizer. The memo is bounded and only saves repeating that.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence

import numpy as np

_SPLIT = re.compile(r"(?= \S)")
#: White space other than the space, tab and line ends.
_OTHER = "\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Python takes these for white space, the tokenizers library doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A Latin word and ASCII punctuation behind it; the pre-tokenizers part the two.
_TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
#: Byte-level alphabets show bytes that aren't printable as characters from 256 on.
_SHOWN = {}
for _b in range(256):
    if not (33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b):
        _SHOWN[_b] = chr(256 + len(_SHOWN))


class _Memo(dict):
    #: Longer pieces are not remembered, so that the number of pieces bounds the bytes.
    longest = 64

    def __init__(self, tokenizer, folds: bool, capacity: int):
        super().__init__()
        self.tokenizer, self.model, self.folds, self.capacity = tokenizer, tokenizer.model, folds, capacity
        self.marks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def bpe(self, word: str, lead: str) -> bytes:
        """Ids of a word of Latin letters, behind a space or (lead empty) not."""
        if self.folds:
            word = word.lower()
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("H", [t.id for t in self.model.tokenize(lead + shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        """A piece behind a space; one that starts with NUL is a line end and what follows it."""
        if 2 * len(self) >= self.capacity:  # two generations: what is used meanwhile comes over
            self.old = dict(self)
            self.clear()
        out = self.old.get(piece)
        if out is not None:
            self[piece] = out
            return out
        if piece[:1] == "\0" and not self.folds:
            word, lead, space, start = piece[1:], "", "", self.mark("\n")
        else:
            word, lead, space, start = piece, "" if self.folds else "Ġ", "" if self.folds else " ", b""
        if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)):
            out = start + self.bpe(word, lead)
        elif m := _TAILED.fullmatch(word):
            out = start + self.bpe(m[1], lead) + self.mark(m[2])
        else:
            out = start + self.whole(space + word)
        if len(piece) <= self.longest:
            self[piece] = out
        return out

    def mark(self, mark: str) -> bytes:
        out = self.marks.get(mark)
        if out is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            out = self.marks[mark] = self.whole(mark)
        return out


class MemoEncoder:
    """encode() gives the ids of each text as little-endian uint16 bytes; `capacity` pieces are remembered at most."""

    _made: dict[tuple[str, int], MemoEncoder] = {}

    def __init__(self, path: str, capacity: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 ids is needed")
        #: With a normalizer that folds white space, pieces carry no leading space and any white space splits.
        self.folds = self.tokenizer.normalizer is not None
        self.memo = _Memo(self.tokenizer, self.folds, capacity)

    @classmethod
    def of(cls, path: str, capacity: int = 1_000_000) -> MemoEncoder:
        """One encoder per path and process, so that its memo outlives a task."""
        key = path, capacity
        if key not in cls._made:
            cls._made[key] = cls(path, capacity)
        return cls._made[key]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        get, whole, join, out = self.memo.__getitem__, self.memo.whole, b"".join, []
        end = b"" if self.folds else self.memo.mark("\n")
        for t in texts:
            if self.folds:
                out.append(whole(t) if _CONTROL.search(t) else join(map(get, t.split())))
            else:
                keys: list[str] = []
                plain = "\0" not in t and "\t" not in t and "\r" not in t and not any(c in t for c in _OTHER)
                if plain:  # single spaces and line ends, none beside another
                    for line in t.split("\n"):
                        p = line.split(" ")
                        if "" in p:
                            plain = False
                            break
                        p[0] = "\0" + p[0]
                        keys += p
                if plain:
                    out.append(join(map(get, keys))[len(end) :])
                else:
                    p = [x[n > 0 :] for n, x in enumerate(_SPLIT.split(t))]
                    out.append(whole(p[0]) + join(self.memo.whole(" " + x) if x[:1] == "\0" else get(x) for x in p[1:]))
        return out


def as_uint32(raw: bytes, end: int | None = None) -> np.ndarray:
    """Ids of encode() as little-endian unsigned 32-bit integers, with an end id."""
    ids = np.frombuffer(raw, "<u2").astype("<u4")
    return ids if end is None else np.append(ids, np.array([end], "<u4"))
