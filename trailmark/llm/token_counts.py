"""Token counts of a unigram tokenizer, without building the tokens.

A text is cut before every blank, as the tokenizer does (a blank becomes its word
mark, and a text without a leading blank gets one). Within a word an Aho-Corasick
automaton enumerates all vocabulary pieces, and dynamic programming over the end
positions carries only the best score and its piece count. Ties follow the
tokenizer: of two equal scores the path found first stays, that is the longer last
piece; a character that is no piece by itself may also be unknown, at the lowest
score minus 10, and falls back on its UTF-8 bytes where the vocabulary has all byte
pieces (else a run of unknown characters is one token).

The vocabulary is read on the driver and broadcast; its file is checked to be
small. Counts of frequent words are remembered per task in a bounded table.

Defined cases: null and empty texts have no tokens; repeated documents each get
their row; other columns are carried along unless a result column has the name.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from trailmark.llm.tasks import map_batches
from trailmark.llm.words import without_columns

# The word mark and the penalty of unknown characters.
WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0

MAX_VOCABULARY_BYTES = 64 << 20
REMEMBERED_WORDS = 400_000
RESULTS = ["n_tokens", "token_score"]


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores.

    The file orders its pieces by merge rank; the scores are log probabilities that
    fall with the rank by Zipf's law.
    """
    import sentencepiece

    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary larger than {MAX_VOCABULARY_BYTES} bytes: {path}")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return [(piece, -math.log(rank + 1) - total) for rank, piece in enumerate(pieces)]


class Counter(dict):
    """(pieces, score) of words, computed when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = {piece for piece, _ in vocabulary}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{byte:02X}>" in self.pieces for byte in range(256))

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = self.count(WORD_MARK + word)
        return found

    def count(self, word: str) -> tuple[int, float]:
        """Viterbi over end positions; all candidates of an end come longest first."""
        score, count, unknown = [0.0], [0], set()
        known = self.pieces
        at = 0  # the last end that is final
        best, pieces = -math.inf, 0
        for last, (length, value) in [*self.automaton.iter(word), (len(word), (0, 0.0))]:
            while at < last:  # no more candidates for the end behind character `at`
                if word[at] not in known and score[at] + self.unknown > best:
                    best = score[at] + self.unknown
                    if self.bytes:
                        pieces = count[at] + len(word[at].encode())
                    else:
                        pieces = count[at] + (at not in unknown)
                    unknown.add(at + 1)
                score.append(best)
                count.append(pieces)
                at, best = at + 1, -math.inf
            if length:
                start = last + 1 - length
                candidate = score[start] + value
                if candidate > best:
                    best, pieces = candidate, count[start] + 1
        return count[-1], score[-1]

    def of_text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(WORD_MARK, " ")
        words = text.split(" ")
        if text[0] == " ":
            del words[0]
        total, score = 0, 0.0
        for pieces, value in map(self.__getitem__, words):
            total += pieces
            score += value
        return total, score


_counters: dict[int, Counter] = {}


def counter_of(key: int, shared) -> Counter:
    """The worker's counter, kept from one task to the next."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(shared.value)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """The documents with ``n_tokens`` and the score of the best path, ``token_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash(tuple(vocabulary))
    names = without_columns(docs.columns, RESULTS)
    if text not in names:
        raise ValueError(f"the text column may not be named {text}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(key, shared)
        for batch in batches:
            column = batch.column(text)
            found = [counter.of_text(column[i].as_py()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                names=names + RESULTS,
            )

    schema = T.StructType(
        [*docs.select(*names).schema.fields]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("token_score", T.DoubleType())]
    )
    return map_batches(docs, count, schema)
