"""Token counts by a Viterbi that keeps counts only.

The vocabulary of a unigram tokenizer is a list of pieces with scores. An
Aho-Corasick automaton reports every piece that ends at each character;
dynamic programming carries the best score up to each character and the number
of pieces on that best way, never the pieces themselves.

Ties follow the tokenizer: of equally good ways to a character, the one whose
last piece starts first wins, since starts are tried in order and only a better
score replaces an earlier one. A character that no piece of one character covers
may stand alone at a penalty below the worst score; it counts as one token per
UTF-8 byte, for which the vocabulary has pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_PENALTY = 10.0
# Words whose counts a task remembers.
_CACHE = 1_000_000
_NORMAL = 1
_NEVER = float("-inf")


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float]
    unknown: float  # score of a character without a piece of its own

    @property
    def splits(self) -> bool:
        """Whether no piece holds a space after another character, so that a text
        may be cut before every space that follows another character."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.pieces)


def read_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a SentencePiece model file: field 1 of the
    message holds pieces, of which 1 is the text, 2 a 32-bit float, 3 the kind."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            tag, at = varint(at)
            kind = tag & 7
            if kind == 0:
                start = at
                _, at = varint(at)
            elif kind == 2:
                size, start = varint(at)
                at = start + size
            else:
                start, at = at, at + (4 if kind == 5 else 8)
            yield tag >> 3, start, at

    out = []
    for number, start, end in fields(0, len(raw)):
        if number != 1:
            continue
        piece, score, kind = "", 0.0, _NORMAL
        for inner, a, b in fields(start, end):
            if inner == 1:
                piece = raw[a:b].decode("utf-8")
            elif inner == 2:
                score = struct.unpack("<f", raw[a:b])[0]
            elif inner == 3:
                kind = varint(a)[0]
        out.append((piece, score, kind))
    return out


def vocabulary(raw: bytes) -> Vocabulary:
    """The normal pieces of a model file. Unknown characters fall back to bytes."""
    pieces = {p: s for p, s, kind in read_pieces(raw) if kind == _NORMAL}
    return Vocabulary(pieces, min(pieces.values()) - _PENALTY)


def normalized(text: str) -> str:
    """Spaces as the tokenizer writes them, with one before the text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Counter:
    """Counts tokens of texts; counts of words are kept between calls."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.automaton = ahocorasick.Automaton()
        for piece, score in known.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in known.pieces if len(p) == 1)
        self.words: dict[str, int] = {}
        # A word is a run of spaces with what follows, up to the next space.
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if known.splits else None

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of tokens of the best way through a normalized text."""
        if not self.singles.issuperset(text):
            return self._best_with_unknown(text)
        score, count = [_NEVER] * (len(text) + 1), [0] * (len(text) + 1)
        score[0] = 0.0
        # Pieces are reported by their end, and of one end the longest first.
        for end, (size, value) in self.automaton.iter(text):
            start = end + 1 - size
            way = score[start] + value
            if way > score[end + 1]:
                score[end + 1] = way
                count[end + 1] = count[start] + 1
        return score[-1], count[-1]

    def _best_with_unknown(self, text: str) -> tuple[float, int]:
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        score, count = [0.0], [0]
        for i, found in enumerate(ends):
            top, pieces, alone = None, 0, True
            # The longest piece starts first.
            for size, value in sorted(found, reverse=True):
                way = score[i + 1 - size] + value
                if top is None or way > top:
                    top, pieces = way, count[i + 1 - size] + 1
                alone = alone and size > 1
            if alone:
                way = score[i] + self.known.unknown
                if top is None or way > top:
                    top, pieces = way, count[i] + len(text[i].encode("utf-8", "surrogatepass"))
            score.append(top)
            count.append(pieces)
        return score[-1], count[-1]

    def count(self, text: str | None) -> int:
        """Tokens of a text. Scores are whole numbers, so that sums are exact in
        any order and words can be counted by themselves."""
        if not text:
            return 0
        text = normalized(text)
        if self.split is None:
            return self.best(text)[1]
        if len(self.words) > _CACHE:
            self.words.clear()
        known, total = self.words, 0
        for word in self.split.findall(text):
            n = known.get(word)
            if n is None:
                n = known[word] = self.best(word)[1]
            total += n
        return total


@lru_cache(maxsize=1)
def _counter(raw: bytes) -> Counter:
    return Counter(vocabulary(raw))


def token_counts(
    docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id and n_tokens, for the tokenizer file `model`.

    Null and empty texts have 0 tokens; repeated rows are rows of their own.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # One tokenizer's file, which does not grow with the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
            )

    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


def read_model(path: str = VOCABULARY) -> bytes:
    """A tokenizer file; it is read by the driver, and executors need no copy."""
    with open(path, "rb") as file:
        return file.read()
