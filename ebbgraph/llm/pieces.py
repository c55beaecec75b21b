"""A SentencePiece model's pieces: vocabulary matches by Aho-Corasick, and the tokenizer's own rule for a path.

Unigram models take the path with the best sum of scores. Models of the BPE kind merge by rank, which
no sum of scores reproduces; there a sequence of pieces is the tokenizer's result exactly if every
piece is what merging makes of itself and every two neighbours stay apart when merged together. So
each boundary of a text has exactly one last piece, and dynamic programming over the vocabulary
matches that end at a boundary finds it: the same lattice, with neighbours' fit in place of the score.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
NORMAL, UNKNOWN, BYTE, UNUSED = 1, 2, 6, 5  # fixed values: the format's piece types
UNIGRAM, BPE = 1, 2  # fixed values: the format's model types
UNKNOWN_PENALTY = 10.0  # fixed value: the library's score of an unknown character below the worst piece
MEMO = 200_000  # entries of half a memo at most
LONGEST_KEY = 64  # characters of a key that is remembered, at most: with MEMO it bounds a memo in bytes


class Memo(dict):
    """Values made on first use. A full memo keeps what it has as the older half and starts anew; long keys stay out."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make
        self.older: dict = {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Pieces:
    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is (identity normaliser) are read")
        if any(p.type not in (NORMAL, UNKNOWN, BYTE, 3) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = _float32(min(self.scores.values()) - UNKNOWN_PENALTY)
        self.bytes = [i for _, i in sorted((int(p.piece[3:5], 16), i) for i, p in enumerate(proto.pieces) if p.type == BYTE)]
        self.longest = max(map(len, self.ids))
        #: neighbouring characters inside any piece: elsewhere no piece crosses, and all paths meet
        self.bound = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        self.words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.outputs = {p: struct.pack("<i", i) for p, i in self.ids.items()}
        self.fits = Memo(lambda pair: self._fit(*pair))
        self.parts = Memo(self._merge)
        #: what each id stands for in a decoded text
        self.shown = [b""] * len(proto.pieces)
        for p, i in self.ids.items():
            self.shown[i] = p.replace(SPACE, " ").encode()
        for value, i in enumerate(self.bytes):
            self.shown[i] = bytes([value])
        self.shown[self.unknown] = " ⁇ ".encode()

    def normalise(self, text: str) -> str:
        """What the pieces are matched against: spaces as visible marks, one put in front."""
        return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else ""

    def output(self, piece: str) -> bytes:
        """The ids of a piece, or of a character that is none, as packed integers."""
        found = self.outputs.get(piece)
        if found is None:
            ids = [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]
            found = struct.pack(f"<{len(ids)}i", *ids)
        return found

    def _merge(self, piece: str):
        """Scores of the merges that build a piece, in order, with its first and last symbol after each; None if they don't."""
        symbols, scores, firsts, lasts = list(piece), [], [piece[0]], [piece[-1]]
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.scores.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return scores, firsts, lasts

    def _fit(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when their characters are merged together, best score and then leftmost first."""
        a, b = self.parts[left], self.parts[right]
        if a is None or b is None:
            return False
        (a_scores, _, ends), (b_scores, starts, _) = a, b
        p = q = 0
        while True:
            across = self.scores.get(ends[p] + starts[q])
            next_a = a_scores[p] if p < len(a_scores) else None
            next_b = b_scores[q] if q < len(b_scores) else None
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a >= next_b):
                p += 1
            else:
                q += 1

    def matches(self, text: str, start: int, end: int) -> list[list[str]]:
        """The vocabulary matches that end at each character from ``start`` to ``end``, the longer first."""
        end = min(end, len(text))
        out: list[list[str]] = [[] for _ in range(end - start)]
        for at, piece in self.automaton.iter(text, max(0, start - self.longest + 1), end):
            if at >= start:
                out[at - start].append(piece)
        return out

    def known(self, text: str) -> bool:
        """Whether every character is a piece, so that every boundary ends one."""
        return self.letters.issuperset(text)

    def segments(self, word: str) -> list[str]:
        """A text cut wherever no piece can cross."""
        out, start, bound = [], 0, self.bound
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in bound:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def split_words(self, text: str) -> list[str]:
        """A normalised text cut before its words where the vocabulary allows, else whole."""
        if not self.words or not text:
            return [text] if text else []
        if SPACE + SPACE in text or text[0] != SPACE:
            out, start, seen = [], 0, text.find(SPACE, 1)
            while seen != -1:
                if text[seen - 1] != SPACE:
                    out.append(text[start:seen])
                    start = seen
                seen = text.find(SPACE, seen + 1)
            out.append(text[start:])
            return out
        return [SPACE + w for w in text[1:].split(SPACE)]


def _float32(x: float) -> float:
    return struct.unpack("<f", struct.pack("<f", x))[0]


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """The pieces of a model, built once in a Python worker."""
    return Pieces(model)
