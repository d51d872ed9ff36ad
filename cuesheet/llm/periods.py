"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with a smallest period q, at least two periods and
`SHORTEST` words long, that no neighbouring word extends. For every run some
dyadic block of words in it stands again q words later, in a window next to the
block whose place depends on the block's length alone.

1. Prefix doubling sorts the suffixes of each text and names its blocks of
   every dyadic length: the suffixes that start with a block are an interval
   of the suffix array.
2. A wavelet tree over the suffix array, less the suffixes whose first words
   stand once, answers range successors: the occurrences of a block in a window.
3. Those of one window are a progression; each of its members is a candidate
   period, but for those that the block's own period explains. A candidate is
   extended to both sides by the blocks' names.
4. Of candidates that span the same words the smallest is their period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cuesheet.llm import shingles
from cuesheet.llm.common import unique_name

SHORTEST = 12
RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))
# Exponent of the shortest block, and bytes of texts that are searched together.
_LEAST = 2
_BATCH_BYTES = 1 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


# --- names and suffix array -------------------------------------------------


def _grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of small whole numbers, and where a new pair begins in it."""
    n = len(first)
    place = max(1, (n - 1).bit_length())
    wide = max(1, int(second.max(initial=0)).bit_length())
    if int(first.max(initial=0)).bit_length() + wide + place < 63:
        key = (((first << wide) | second) << place) | np.arange(n)
        key.sort()
        order = key & ((1 << place) - 1)
        key >>= place
    else:
        order = np.lexsort((second, first))
        key = np.stack([first[order], second[order]], axis=1)
    new = np.ones(n, dtype=bool)
    if n > 1:
        differs = key[1:] != key[:-1]
        new[1:] = differs if differs.ndim == 1 else differs.any(axis=1)
    return order, new


class Blocks:
    """Names of all blocks of 2^k words of a batch of texts, by k.

    The name of a block is the first place of its interval in the suffix
    array, so equal names are equal blocks of one text, and `size` tells the
    length of the interval that begins at a place. A block that the end of its
    text cuts short equals no other.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, ends: np.ndarray):
        n = len(words)
        _, word = np.unique(words, return_inverse=True)
        order, new = _grouped(text, word)
        self.suffixes = order.astype(np.int64)
        name = np.empty(n, dtype=np.int32)
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, n))
        name[order] = np.repeat(starts, counts)
        size = np.zeros(n, dtype=np.int32)
        size[starts] = counts
        self.names, self.sizes = [name], [size]
        last = ends[text]
        while (size[starts] > 1).any() or len(self.names) <= _LEAST:
            width = 1 << (len(self.names) - 1)
            name, size = name.copy(), size.copy()
            places = np.flatnonzero(size[name[self.suffixes]] > 1)
            at = self.suffixes[places]
            after = at + width
            inside = after < last[at]
            second = np.zeros(len(at), dtype=np.int64)
            second[inside] = self.names[-1][after[inside]].astype(np.int64) + 1
            order, new = _grouped(name[at].astype(np.int64), second)
            # The places of a group stay its own, so sorted members fill them in order.
            at = at[order]
            self.suffixes[places] = at
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(at)))
            starts = places[heads]
            size[places] = 0
            size[starts] = counts
            name[at] = np.repeat(starts, counts)
            self.names.append(name)
            self.sizes.append(size)
        self.last = last

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from `a` on equal those from `b` on, of one text; a < b."""
        a, b = a.copy(), b.copy()
        start, last = b.copy(), self.last[a]
        for k in range(len(self.names) - 2, -1, -1):  # the longest blocks all differ
            live = b < last
            live[live] = self.names[k][a[live]] == self.names[k][b[live]]
            a[live] += 1 << k
            b[live] += 1 << k
        return b - start

    def behind(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words before `a` equal those before `b`; texts begin at `first`."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.names) - 2, -1, -1):
            step = 1 << k
            live = a - step >= first
            live[live] = self.names[k][a[live] - step] == self.names[k][b[live] - step]
            a[live] -= step
            b[live] -= step
        return start - a


class WaveletTree:
    """Range counts and order statistics over whole numbers of so many bits.

    One level per bit, highest first: each keeps, stably sorted by the bits
    before, how many zero bits stand before every place.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.split = bits, [], []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places [low, high) are less than `bound`."""
        count = np.zeros(len(low), dtype=np.int64)
        over = bound >> self.bits > 0
        whole = high - low
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zeros, split = self.zeros[level], self.split[level]
            a, b = zeros[low], zeros[high]
            one = (bound >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low = np.where(one, split + low - a, a)
            high = np.where(one, split + high - b, b)
        return np.where(over, whole, count)

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a rank, from 0, among those at places [low, high)."""
        value = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            zeros, split = self.zeros[level], self.split[level]
            a, b = zeros[low], zeros[high]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            low = np.where(one, split + low - a, a)
            high = np.where(one, split + high - b, b)
            value = value << 1 | one
        return value


# --- candidates and runs ----------------------------------------------------


def _windows(k: int) -> list[tuple[int, int, int]]:
    """(distance between blocks, first and last lag but one) of the windows in
    which blocks of 2^k words are sought.

    A run of period q has max(q, SHORTEST - q) words that stand again q words
    later. Aligned blocks of L words, one every s, leave none of L + s - 1
    words without one; a window has no more lags than the block has words."""
    size = 1 << k
    if k == _LEAST:
        return [(2, 1, 5), (2, 5, 7), (4, 7, 11), (4, 11, 15)]
    return [(size, 2 * size - 1, 3 * size - 1), (size, 3 * size - 1, 4 * size - 1)]


def _candidates(blocks: Blocks, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): a block of a text and where it stands again; `first` is
    the place at which the text of each place begins."""
    n = len(first)
    none = np.zeros(0, dtype=np.int64)
    name, size = blocks.names[_LEAST], blocks.sizes[_LEAST]
    repeats = size[name] > 1
    if not repeats.any():
        return none, none
    # Only suffixes whose first words stand twice can answer.
    kept = repeats[blocks.suffixes]
    place = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(kept, out=place[1:])
    own = blocks.suffixes[kept]
    bits = max(1, int((blocks.last - first).max()).bit_length())
    tree = WaveletTree(own - first[own], bits)
    found_at, found_lag = [none], [none]
    live = np.flatnonzero(repeats)
    for k in range(_LEAST, len(blocks.names)):
        name, size = blocks.names[k], blocks.sizes[k]
        live = live[size[name[live]] > 1]
        for step, low, high in _windows(k):
            local = live - first[live]
            at = live[(local % step == 0) & (live + low < blocks.last[live])]
            if not len(at):
                continue
            begin = place[name[at]]
            end = begin + size[name[at]]
            local = at - first[at]
            before, until = tree.below(begin, end, local + low), tree.below(begin, end, local + high)
            some = until > before
            at, begin, end, before, until = (x[some] for x in (at, begin, end, before, until))
            origin = first[at]
            one = tree.ranked(begin, end, before) + origin
            found_at.append(at)
            found_lag.append(one - at)
            more = until - before > 1
            at, begin, end, before, until, origin, one = (
                x[more] for x in (at, begin, end, before, until, origin, one)
            )
            if not len(at):
                continue
            two = tree.ranked(begin, end, before + 1) + origin
            gap, members = two - one, until - before - 1
            # Where the block's own period reaches, a longer lag is no smallest period.
            reach = at + gap + blocks.ahead(at, at + gap) - (1 << k)
            skip = np.maximum(0, np.minimum(members, (reach - one) // gap))
            left = members - skip
            lags = np.repeat(one - at + skip * gap, left)
            rank = np.arange(len(lags)) - np.repeat(np.cumsum(left) - left, left) + 1
            found_at.append(np.repeat(at, left))
            found_lag.append(lags + rank * np.repeat(gap, left))
    return np.concatenate(found_at), np.concatenate(found_lag)


def runs_of(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period;
    `words` are numbers or hashes, text t has those from offsets[t] on."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none, none
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    first = offsets[:-1][text]
    blocks = Blocks(words, text, offsets[1:])
    at, lag = _candidates(blocks, first)
    start = at - blocks.behind(at, at + lag, first[at])
    length = at + lag + blocks.ahead(at, at + lag) - start
    good = length >= np.maximum(SHORTEST, 2 * lag)
    start, length, lag = start[good], length[good], lag[good]
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    own = text[start]
    order = np.lexsort((lag, start))
    return own[order], (start - offsets[own])[order], length[order], lag[order]


def _collapsed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, count: int) -> list[str]:
    """The words at raw[starts:ends] of every text, joined by one space."""
    sizes = ends - starts + 1  # with the space after it
    total = np.append(0, np.cumsum(sizes))
    source = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
    out = raw[np.minimum(source, len(raw) - 1)] if len(raw) else raw
    out[total[1:] - 1] = 32
    edges = total[np.searchsorted(text, np.arange(count + 1))]
    joined = out.tobytes()
    return [joined[a : max(a, b - 1)].decode() for a, b in zip(edges, edges[1:])]


def search(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text of a column."""
    raw, offsets = shingles.column_bytes(column)
    counts, found, texts = [], [], []
    for low, high in shingles.slices(offsets, _BATCH_BYTES):
        part = raw[offsets[low] : offsets[high]]
        own = offsets[low : high + 1] - offsets[low]
        hashes, begin, text = shingles.words(part, own)
        edges = np.searchsorted(text, np.arange(high - low + 1))
        counts.append(np.diff(edges))
        of, start, length, period = runs_of(hashes, edges)
        found.append((of + low, start, length, period))
        # A word goes if some run holds it after its first period.
        change = np.zeros(len(begin) + 1, dtype=np.int64)
        np.add.at(change, edges[of] + start + period, 1)
        np.add.at(change, edges[of] + start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        texts += _collapsed(part, begin[kept], _word_ends(part, begin, own)[kept], text[kept], high - low)
    n = len(column)
    of, start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    edges = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]
    )
    words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), spans), pa.array(texts, pa.string())


def _word_ends(raw: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte after every word that begins at `begin`."""
    stop = np.zeros(len(raw) + 1, dtype=bool)
    stop[:-1] = _SPACE[raw]
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    return stops[np.searchsorted(stops, begin, side="right")]


def periodic_runs(
    docs: DataFrame, text: str = "text", words: str = "words", runs: str = "runs", collapsed: str = "collapsed"
) -> DataFrame:
    """`docs` with three columns: the number of words (runs of characters other
    than ASCII white space), the runs (start and length in words, smallest
    period; by start and period) and the text without the words that repeat a
    run's first period, joined by one space.

    A null text is an empty one: no words, no runs, an empty text. Repeated
    rows are searched each; an empty table gives none. Texts are searched
    whole, about a megabyte of them together; a longer one takes memory for
    its words times the logarithm of its longest repeat. Words are told apart
    by 64-bit hashes.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = search(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, words, runs, collapsed])

    added = StructType().add(words, "long").add(runs, RUNS).add(collapsed, "string")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` made periodic where h % 10 is 0, h being the CRC-32
    of the id as text and g = h // 10: of n words, those from a = g % n on
    repeat the p = 1 + (n - a) // (3 + g % 8) words that begin there. Texts
    without words, and of rows without an id, stay."""
    spot, list_ = unique_name(docs, "spot"), unique_name(docs, "list")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    chosen = docs.withColumn(spot, F.when(h % 10 == 0, F.floor(h / 10))).withColumn(
        list_, F.when(F.col(spot).isNotNull(), F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    )
    n = F.size(list_)
    a = F.try_mod(F.col(spot), n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col(spot) % 8))).cast("int")
    period = F.slice(list_, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(list_, F.lit(1), a), repeated), " ")
    names = [
        (F.when(F.coalesce(n, F.lit(0)) > 0, made).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`"))
        for c in docs.columns
    ]
    return chosen.select(*names)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_runs; start, length,
    period and exponent_milli of the longest run (ties: the first, then the
    smallest period; null without runs); runs_sha256 of the lines
    `start,length,period`; collapsed_sha256 of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", "text")).drop("text")
    best = F.array_min(
        F.transform(
            "runs", lambda r: F.struct((-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"))
        )
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    picked = found.withColumn("best", best)
    length = -F.col("best.rank")
    return picked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * (-best.rank) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
