"""SentencePiece encoding and decoding by streaming Viterbi.

Boundaries of the text are visited once, from left to right. The vocabulary matches that end at a
boundary come from an Aho-Corasick automaton, a chunk at a time; the boundary keeps
the last piece of the best path to it. Any later piece starts at one of the last ``longest``
boundaries, so once the paths back from all of these meet, what lies before the meeting point is
settled: its ids are committed and its part of the window is dropped. Where no piece of the
vocabulary can cross (before a word, beside punctuation) all paths meet at once; such short
segments recur, and their committed ids are kept in a bounded memo.

Models of the unigram kind choose by score, in the library's single precision with its tie rule (the
longer last piece stays); those of the BPE kind by fit of neighbours (see ``pieces``), since a best
sum of scores is not what such a tokenizer returns.

Defined results: null and empty texts give no ids; decoding gives back every text except that a
U+2581 in it returns as a space; a character outside the vocabulary becomes its UTF-8 bytes (or the
unknown id if the model has none); rows are independent, so order, repeats and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import rowwise
from ebbgraph.llm.pieces import BPE, Memo, Pieces, _float32, pieces

CHUNK = 4096  # characters fed to the automaton at a time
SHORT = 64  # characters of a segment that is worth remembering, at most


class Encoder:
    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.short = Memo(self._segment)
        self.by_word = Memo(self._word)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        whole = self.v.normalise(text)
        if self.v.kind == BPE:
            packed = b"".join(map(self.by_word.__getitem__, self.v.split_words(whole)))
        else:
            packed = b"".join(self.stream(whole))
        ids = np.frombuffer(packed, "<i4")
        if not self.v.bytes and len(ids):  # without byte pieces, unknown characters in a row are one
            same = np.r_[False, (ids[1:] == ids[:-1]) & (ids[1:] == self.v.unknown)]
            ids = ids[~same]
        return ids

    def _word(self, word: str) -> bytes:
        return b"".join(self.short[s] if len(s) <= SHORT else b"".join(self.stream(s)) for s in self.v.segments(word))

    def _segment(self, segment: str) -> bytes:
        """The ids of a short segment, whose window is all of it; simpler where every character is a piece."""
        v = self.v
        if not v.known(segment):
            return b"".join(self.stream(segment))
        fits, parts = v.fits, v.parts
        last: list[str | None] = [None] * (len(segment) + 1)
        for end, piece in v.automaton.iter(segment):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if fits[last[start], piece] if start else parts[piece] is not None:
                    last[end] = piece
        return self._ids(last, len(segment))

    def stream(self, text: str) -> Iterator[bytes]:
        """Committed ids, in order."""
        by_fit, longest = self.v.kind == BPE, self.v.longest
        base = 0  # the boundary up to which ids are committed; window[k] belongs to boundary base + k
        last: list[str | None] = [None]
        score: list[float] = [0.0]
        for at in range(0, len(text), CHUNK):
            for k, matches in enumerate(self.v.matches(text, at, at + CHUNK)):
                boundary = at + k + 1
                if by_fit:
                    last.append(self._fitting(matches, last, boundary - base, text[boundary - 1]))
                else:
                    self._scored(matches, last, score, boundary - base, text[boundary - 1])
                if len(last) > 4 * longest and len(last) % longest == 0:
                    met = self._meeting(last, longest)
                    if met:
                        yield self._ids(last, met)
                        base += met
                        last, score = [None, *last[met + 1 :]], score[met:]
        yield self._ids(last, len(last) - 1)

    def _fitting(self, matches: list[str], last: list, here: int, char: str) -> str:
        fits = self.v.fits
        for piece in matches:
            before = last[here - len(piece)] if len(piece) <= here else None
            if len(piece) > here:
                continue
            if self.v.parts[piece] is not None if before is None else fits[before, piece]:
                return piece
        return char  # not in the vocabulary

    def _scored(self, matches: list[str], last: list, score: list[float], here: int, char: str) -> None:
        best, chosen = None, char
        for piece in matches:
            if len(piece) <= here:
                total = _float32(self.v.scores[piece] + score[here - len(piece)])
                if best is None or total > best:
                    best, chosen = total, piece
        if char not in self.v.scores:
            total = _float32(self.v.unknown_score + score[here - 1])
            if best is None or total > best:
                best, chosen = total, char
        last.append(chosen)
        score.append(best)

    @staticmethod
    def _meeting(last: list, longest: int) -> int:
        """The boundary, as an index of the window, where the paths back from its last boundaries meet."""
        open_ = set(range(len(last) - longest, len(last)))
        while len(open_) > 1:
            far = max(open_)
            open_.remove(far)
            open_.add(far - len(last[far]))
        return open_.pop()

    def _ids(self, last: list, end: int) -> bytes:
        path = []
        while end > 0:
            path.append(self.v.output(last[end]))
            end -= len(last[end])
        return b"".join(reversed(path))


def decode(vocabulary: Pieces, ids: np.ndarray) -> str:
    shown = b"".join(map(vocabulary.shown.__getitem__, ids.tolist())).decode(errors="replace")
    return shown[1:] if vocabulary.prefix and shown[:1] == " " else shown


def encode_column(model: bytes):
    """A column function: text to ids."""

    def make():
        encoder = Encoder(pieces(model))
        return encoder.encode

    return rowwise(make, "array<int>")


def decode_column(model: bytes):
    """A column function: ids to text; null gives null."""

    def make():
        vocabulary = pieces(model)
        return lambda ids: None if ids is None else decode(vocabulary, np.asarray(ids, np.int32))

    return rowwise(make, "string")


def encode(docs: DataFrame, model: bytes, into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``into``; a column of that name is replaced."""
    return docs.withColumn(into, encode_column(model)(F.col("text")))


def codec_column(model: bytes):
    """A column function: text to its ids and the SHA-256 of the text that decoding them gives."""

    def make():
        vocabulary = pieces(model)
        encoder = Encoder(vocabulary)

        def one(text):
            ids = encoder.encode(text)
            return ids, hashlib.sha256(decode(vocabulary, ids).encode()).hexdigest()

        return one

    return rowwise(make, "struct<ids: array<int>, decoded_sha256: string>")


def codec(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row: doc_id, n_ids, ids, decoded_sha256."""
    done: Column = codec_column(model)(F.col("text"))
    out = docs.select("doc_id", done.alias("done"))
    return out.select("doc_id", F.size("done.ids").cast("long").alias("n_ids"), "done.ids", "done.decoded_sha256")
