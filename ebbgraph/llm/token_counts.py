"""Token counts without ids: count-only Viterbi over vocabulary matches.

As in ``sentencepiece_codec`` an Aho-Corasick automaton enumerates the vocabulary matches that end
at a boundary and the tokenizer's rule picks the last piece; but a boundary carries only that piece
(and its score, for unigram models) and the number of ids up to it, and no more than the last
``longest`` boundaries are held. There is no way back, and none is needed.

Defined results: null and empty texts have zero tokens; rows are independent, so order, repeats and
extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import rowwise
from ebbgraph.llm.pieces import BPE, Memo, Pieces, _float32, pieces

CHUNK = 4096
SHORT = 64


class Counter:
    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.short = Memo(self._short)
        self.by_word = Memo(self._word)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        whole = self.v.normalise(text)
        if self.v.kind != BPE:
            return self._count(whole)
        return sum(map(self.by_word.__getitem__, self.v.split_words(whole)))

    def _word(self, word: str) -> int:
        return sum(self.short[s] if len(s) <= SHORT else self._count(s) for s in self.v.segments(word))

    def _short(self, text: str) -> int:
        """The count of a short segment; without a ring, and simpler where every character is a piece."""
        v = self.v
        if not v.known(text):
            return self._count(text)
        fits, parts = v.fits, v.parts
        last: list[str | None] = [None] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        for end, piece in v.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if fits[last[start], piece] if start else parts[piece] is not None:
                    last[end], count[end] = piece, count[start] + 1
        return count[-1]

    def _count(self, text: str) -> int:
        v, by_fit, ring = self.v, self.v.kind == BPE, self.v.longest + 1
        last: list[str | None] = [None] * ring  # the state of boundary b is at b % ring
        count, score = [0] * ring, [0.0] * ring
        unknown = [False] * ring
        boundary = 0
        for at in range(0, len(text), CHUNK):
            for matches in v.matches(text, at, at + CHUNK):
                char = text[boundary]
                boundary += 1
                here, chosen, best = boundary % ring, None, None
                for piece in matches:
                    start = boundary - len(piece)
                    if start < 0:
                        continue
                    before = last[start % ring] if start else None
                    if by_fit:
                        if v.parts[piece] is not None if before is None else v.fits[before, piece]:
                            chosen = piece
                            break
                    else:
                        total = _float32(v.scores[piece] + score[start % ring])
                        if best is None or total > best:
                            best, chosen = total, piece
                if not by_fit and char not in v.scores:
                    total = _float32(v.unknown_score + score[(boundary - 1) % ring])
                    if best is None or total > best:
                        best, chosen = total, None
                start = boundary - (len(chosen) if chosen else 1)
                if chosen:
                    more = 1
                elif v.bytes:
                    more = len(char.encode())
                else:
                    more = 0 if start and unknown[start % ring] else 1  # unknown characters in a row are one
                count[here] = (count[start % ring] if start else 0) + more
                last[here], score[here], unknown[here] = chosen or char, best or 0.0, chosen is None
        return count[boundary % ring]


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row: doc_id, n_chars (code points of the text), n_tokens."""
    of = rowwise(lambda: Counter(pieces(model)).count, "bigint")
    return docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), of(F.col("text")).alias("n_tokens")
    )
