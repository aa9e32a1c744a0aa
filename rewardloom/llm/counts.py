"""Token counts of a unigram vocabulary without tokens: Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.pieces import MARK, NORMAL, USER_DEFINED, PieceModel, normalizer_of

_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores so much below the worst piece


class PieceCounter:
    """Counts the pieces of the best segmentation; scores are taken as unigram log-probabilities.

    At each end of a match the earliest start wins among equal scores, and an
    unknown character is taken only where no piece is that character and nothing
    scores as well. Scores add up as doubles from left to right.
    """

    def __init__(self, model: PieceModel, remembered: int = 1 << 19):
        usable = [(text, score) for text, score, kind in model.pieces if kind in (NORMAL, USER_DEFINED) and text]
        self.automaton = ahocorasick.Automaton()
        for text, score in usable:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score, _ in model.pieces) - _UNKNOWN_PENALTY
        self.fallback = model.byte_fallback
        self.normalizer = normalizer_of(model)
        # Sums of whole numbers are exact, so stretches between cuts can be counted apart.
        self.apart = model.splits_at_marks() and all(score == int(score) for _, score in usable)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def best(self, text: str) -> int:
        """Number of pieces of one stretch."""
        end = len(text)
        score, count, open_run = [0.0] + [None] * end, [0] * (end + 1), [False] * (end + 1)
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for at in range(end):
            top, pieces, single = None, 0, False
            while match is not None and match[0] == at:  # longest first
                length, own = match[1]
                start = at + 1 - length
                total = score[start] + own
                if top is None or total > top:
                    top, pieces = total, count[start] + 1
                single |= length == 1
                match = next(matches, None)
            if not single and (top is None or score[at] + self.unknown > top):
                top = score[at] + self.unknown
                open_run[at + 1] = True
                pieces = count[at] + (len(text[at].encode()) if self.fallback else not open_run[at])
            score[at + 1], count[at + 1] = top, pieces
        return count[end]

    def count(self, text: str) -> int:
        """Pieces of a whole text. Counts of short stretches are remembered, up to a bounded number."""
        normal = self.normalizer.normalize_str(text)
        if not self.apart:
            return self.best(normal)
        total, known = 0, self.known
        for stretch in _STRETCH.findall(normal):
            number = known.get(stretch)
            if number is None:
                number = self.best(stretch)
                if len(stretch) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[stretch] = number
            total += number
        return total


def _counter(sent: object) -> Callable:
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(PieceModel.parse(sent.value))
        for texts in batches:
            yield pa.array([None if (t := v.as_py()) is None else counter.count(t) for v in texts], pa.int64())

    return F.arrow_udf(count, "long", F.ArrowUDFType.SCALAR_ITER)


def token_counts(documents: DataFrame, model_bytes: bytes, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Documents with the number of pieces of each whole text; null for a null text, 0 for an empty one.

    The vocabulary and scores come from a SentencePiece file and are read as a
    unigram model's. A column named ``out`` is replaced; repeated rows are counted each.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model_bytes)
    return documents.withColumn(out, _counter(sent)(F.col(text)))
