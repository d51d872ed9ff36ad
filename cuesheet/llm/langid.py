"""Language identification by a linear-chain conditional random field over words.

Features of a word (itself, its affixes, its letter pairs and triples), hashed,
carry a learned weight per language, and pairs of neighbouring words a learned
transition weight, so that code-switched text can be labelled word by word.
Forward-backward gives every word its probabilities; a document's language is
the one with the largest expected number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuesheet.llm import crf
from cuesheet.llm.common import unique_name

# The model is fitted on at most this many labelled documents per language.
FIT_DOCUMENTS = 300
FIT_CHAINS = 3000
CHAIN_WORDS = 32
ITERATIONS = 60
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Words whose scores a task remembers, and words whose chains it holds at a time.
_CACHE = 200_000
_WORDS_AT_A_TIME = 100_000
_SEGMENT = 128


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    transitions: np.ndarray  # from, to


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _hashed(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(parts[0].shape, salt, dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(46)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of all words: the whole word, prefixes and suffixes
    of up to four letters, and every two and three neighbouring letters."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    rows, ids = [], []
    low = 0
    for high in (8, 16, 32, 1 << 40):  # words of similar length share a matrix
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        if not len(at):
            continue
        size = lengths[at]
        width = int(size.max())
        step = max(1, 4_000_000 // width)
        for i in range(0, len(at), step):
            own, n = at[i : i + step], size[i : i + step]
            text = np.array([words[j] for j in own], dtype=f"U{width}")
            letters = text.view(np.uint32).reshape(len(own), width)
            whole = np.zeros(len(own), dtype=np.uint64)
            for k in range(width):
                whole = np.where(n > k, (whole + letters[:, k]) * _MIX, whole)
            rows.append(own)
            ids.append(_hashed([whole], 1))
            head = tail = whole * np.uint64(0)
            for k in range(min(4, width)):
                has = n > k
                head = (head + letters[:, k]) * _MIX
                tail = (tail + letters[np.arange(len(own)), np.maximum(n - 1 - k, 0)]) * _MIX
                rows += [own[has], own[has]]
                ids += [_hashed([head[has]], 10 + k), _hashed([tail[has]], 20 + k)]
            for k in range(width - 1):
                two, three = n > k + 1, n > k + 2
                rows += [own[two], own[three]]
                ids.append(_hashed([letters[two, k], letters[two, k + 1]], 30))
                if k + 2 < width:
                    ids.append(_hashed([letters[three, j] for j in (k, k + 1, k + 2)], 31))
                else:
                    ids.append(np.zeros(0, dtype=np.int32))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int32)])


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit by gradient ascent on the likelihood of chains of words cut from
    (language, text) samples; half of the chains change language once."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    by_language = {
        k: [w for w in (words_of(t) for lang, t in samples if lang == name) if w]
        for k, name in enumerate(languages)
    }
    usable = [k for k, texts in by_language.items() if texts]
    count = len(languages)
    if not usable:
        return Model(languages, np.zeros((_TABLE, max(1, count))), np.zeros((count, count)))
    chains, labels = [], []
    for i in range(FIT_CHAINS):
        cut = int(rng.integers(1, CHAIN_WORDS)) if i % 2 else CHAIN_WORDS
        chain, label = [], []
        for part in (cut, CHAIN_WORDS - cut):
            if part:
                k = usable[int(rng.integers(len(usable)))]
                texts = by_language[k]
                text = texts[int(rng.integers(len(texts)))]
                start = int(rng.integers(max(1, len(text) - part + 1)))
                piece = (text[start : start + part] * part)[:part]
                chain += piece
                label += [k] * part
        chains.append(chain)
        labels.append(label)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    index = np.array([[vocabulary[w] for w in c] for c in chains])
    rows, ids = features(list(vocabulary))
    weights, moves = crf.fit(
        rows, ids, len(vocabulary), _TABLE, index, np.array(labels), count, ITERATIONS
    )
    return Model(languages, weights.astype(np.float32), moves)


def marginals(model: Model, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probabilities of every language for every word, by forward-backward over
    each chain; `word` holds the words' scores, chain after chain, and `starts`
    the first word of every chain (none is empty).

    Chains are cut into segments whose forward maps are found side by side;
    then the maps are chained, and last the words of all segments filled in.
    """
    n, count = word.shape
    emit = np.exp(word - word.max(axis=1, keepdims=True))
    move = np.exp(model.transitions)
    sizes = np.diff(np.append(starts, n))
    per = -(-sizes // _SEGMENT)
    chain = np.repeat(np.arange(len(starts)), per)
    order = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[chain] + order * _SEGMENT
    length = np.minimum(sizes[chain] - order * _SEGMENT, _SEGMENT)
    longest = np.argsort(-length, kind="stable")
    first, length = first[longest], length[longest]
    steps = int(length[0]) if len(length) else 0
    # How many segments, longest first, have a word at each step.
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    maps = np.broadcast_to(np.eye(count), (len(first), count, count)).copy()
    for t in range(steps):
        m = active[t]
        step = (maps[:m].reshape(-1, count) @ move).reshape(m, count, count)
        step *= emit[first[:m] + t][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        maps[:m] = step
    place = np.empty(len(longest), dtype=np.int64)
    place[longest] = np.arange(len(longest))
    into = np.ones((len(first), count))
    out = np.ones((len(first), count))
    by_order = np.argsort(order, kind="stable")
    edges = np.searchsorted(order[by_order], np.arange(int(order.max(initial=0)) + 2))
    for j in range(1, len(edges) - 1):
        now = by_order[edges[j] : edges[j + 1]]
        here, last = place[now], place[now - 1]
        value = np.einsum("si,sij->sj", into[last], maps[last])
        into[here] = value / value.sum(axis=1, keepdims=True)
    for j in range(len(edges) - 2, 0, -1):
        now = by_order[edges[j] : edges[j + 1]]
        here, last = place[now], place[now - 1]
        value = np.einsum("sij,sj->si", maps[here], out[here])
        out[last] = value / value.sum(axis=1, keepdims=True)
    post = np.empty_like(emit)
    value = into
    for t in range(steps):
        m = active[t]
        value = (value[:m] @ move) * emit[first[:m] + t]
        value /= value.sum(axis=1, keepdims=True)
        post[first[:m] + t] = value
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        post[at] *= out[:m]
        back = (emit[at] * out[:m]) @ move.T
        out[:m] = back / back.sum(axis=1, keepdims=True)
    return post / post.sum(axis=1, keepdims=True)


class Labeller:
    """Applies a model to texts; scores of words are kept between calls."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _index(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > _CACHE:
            self.rows, self.table = {}, self.table[:0]
        new = list(set(words).difference(self.rows))
        if new:
            base = len(self.rows)
            self.rows.update(zip(new, range(base, base + len(new))))
            pair = features(new)
            self.table = np.vstack([self.table, crf.scores(self.model.weights, *pair, len(new))])
        return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))

    def words(self, text: str) -> np.ndarray:
        """Probabilities (word, language) of one text."""
        index = self._index(words_of(text))
        return marginals(self.model, self.table[index], np.zeros(1, dtype=np.int64))

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share of the expected words, for every text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return names, scores
        pending: list[str] = []
        owners: list[int] = []
        starts: list[int] = []

        def flush() -> None:
            if not owners:
                return
            index = self._index(pending)
            post = marginals(self.model, self.table[index], np.array(starts))
            mass = np.add.reduceat(post, np.array(starts), axis=0)
            mass /= mass.sum(axis=1, keepdims=True)
            best = mass.argmax(axis=1)
            for i, k, share in zip(owners, best, mass[np.arange(len(best)), best]):
                names[i], scores[i] = self.model.languages[k], min(1.0, float(share))
            pending.clear(), owners.clear(), starts.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                owners.append(i)
                starts.append(len(pending))
                pending.extend(words)
            if len(pending) >= _WORDS_AT_A_TIME:
                flush()
        flush()
        return names, scores


def fitted(labelled: DataFrame, per_language: int = FIT_DOCUMENTS) -> Model:
    """A model from at most `per_language` documents of each language of
    (lang, text), those of the smallest digests, copies once.

    Of a language with many different texts only those whose digest lies below
    a bound are ranked, about four times as many as are wanted, so that no task
    ranks more than that however common a language is.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 32).alias("digest")
    )
    counts = known.groupBy("lang").agg(F.approx_count_distinct("digest")).collect()
    bound = F.lit(1 << 32)
    for name, count in counts:
        if count > 4 * per_language:
            share = F.lit((4 * per_language << 32) // count)
            bound = F.when(F.col("lang") == name, share).otherwise(bound)
    rank = Window.partitionBy("lang").orderBy("digest", "text")
    sample = (
        known.where(F.col("digest") < bound)
        .dropDuplicates(["lang", "text"])
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= per_language)
        .orderBy("lang", "rank")
    )
    return fit([(r["lang"], r["text"]) for r in sample.select("lang", "text").collect()])


def is_held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id, modulo 3, is 1."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def identify(
    docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """`docs` with the columns `label` and `score` (0 to 1).

    `und` with score 0: the text is null or has no letter, or no language was
    learned. Repeated rows are predicted each; whole texts are read.
    """
    at = docs.columns.index(text)
    # The table of weights has a fixed size, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            names, scores = labeller.documents(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, label, score],
            )

    schema = StructType([*docs.schema.fields, *StructType().add(label, "string").add(score, "double")])
    return docs.mapInArrow(run, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. The model learns
    from the text and language of documents that are not held out."""
    split = docs.select("doc_id", "text", "lang", is_held_out().alias("held_out"))
    model = fitted(split.where(~F.col("held_out")).select("lang", "text"))
    return identify(split.select("doc_id", "held_out", "text"), model).drop("text")


def with_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents in which one learned language has `least` of the words at
    least, with their own columns; the others, and `und`, are rejected.

    Without any labelled document there is nothing to judge by: all are kept.
    """
    model = fitted(docs.where(~is_held_out()).select("lang", "text"))
    if not model.languages:
        return docs
    label, score = unique_name(docs, "lang_pred"), unique_name(docs, "score")
    labelled = identify(docs, model, "text", label, score)
    return labelled.where((F.col(label) != "und") & (F.col(score) >= least)).drop(label, score)
