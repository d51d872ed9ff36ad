"""Benchmark decontamination by templates, for questions with other parameters too.

Numbers, names and units become typed placeholders. Windows of the resulting
templates are joined by hash between documents and benchmark items. Where
windows follow one another as in the item, the same value of the item must always
meet the same value of the document; values that differ may meet equal ones.
Besides, windows of the words as they are, in lower case, are joined, since
capitals tell no names in titles or in texts all in capitals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm import shingles
from cuesheet.llm.bloom import bloom_filter, maybe_in
from cuesheet.llm.common import unique_name, written

WINDOW = 5
# Words of a window that must not be placeholders.
ANCHORS = 3
# Part of an item's windows that a document must hold,
CONTAINED = 0.5
# or as many neighbouring windows of the item (13 words), whatever their part.
RUN = 9

UNITS = """
mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms
ounce ounces oz pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons
second seconds sec minute minutes min hour hours h day days week weeks month months year years
dollar dollars euro euros cent cents usd eur percent degree degrees kmh mph watt watts kw volt volts
""".split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))
_PLAIN = np.uint64(0x504C4149)
_SCALE = 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_SMALL = (_BYTES >= 97) & (_BYTES <= 122)
_JOINT = np.isin(_BYTES, list(b".,"))
_STOP = np.isin(_BYTES, [10, 13, *b".!?:"])
_BLANK = np.isin(_BYTES, [9, 11, 12, 32, *b"\"'()[]*_-"])
_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("key", pa.int64()),
        ("at", pa.int32()),
        ("plain", pa.bool_()),
        ("width", pa.int32()),
        ("window", pa.int64()),
        ("slots", pa.list_(pa.int64())),
    ]
)
_DDL = "id long, key long, at int, plain boolean, width int, window long, slots array<long>"


def template(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, text) of every word of UTF-8 texts.

    The token is the hash of the word in lower case, or a placeholder: NUMBER
    for digits with separators between them, UNIT for a word of `UNITS` right
    after a number, NAME for a capital word not at the start of a sentence, if
    it or its neighbours have small letters: in a run of capitals none tells a
    name. Characters of scripts without spaces are words of their own.
    The value of a placeholder is the hash of what stood there, else 0.
    """
    low = _LOWER[raw]
    if len(raw):  # capital letters of Latin-1 and Greek stand 32 below the small ones
        accented = np.zeros(len(raw), dtype=bool)
        accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low = np.where(accented, low + 32, low).astype(np.uint8)
    digit = _DIGIT[raw]
    solid = _LETTER[raw] | digit
    solid[1:-1] |= _JOINT[raw[1:-1]] & digit[:-2] & digit[2:]
    value, start, _ = shingles.words(low, _cuts(raw, offsets), solid)
    text = np.searchsorted(offsets, start, side="right") - 1
    first = raw[start]
    number = _DIGIT[first]
    upper = _UPPER[first] | ((first == 0xC3) & (raw[np.minimum(start + 1, len(raw) - 1)] <= 0x9E))
    # The last byte before a word that is neither blank nor a quotation mark tells its sentence's start.
    position = np.where(_BLANK[raw], 0, np.arange(1, len(raw) + 1))
    last = np.concatenate([[0], np.maximum.accumulate(position)])[start] if len(raw) else start
    opens = (last <= offsets[text]) | _STOP[raw[np.maximum(last - 1, 0)]]
    token = value.copy()
    follows = np.zeros(len(token), dtype=bool)
    follows[1:] = number[:-1] & (text[1:] == text[:-1])
    unit = follows & ~number
    unit[unit] = np.isin(value[unit], _UNIT_HASHES)
    small = np.add.reduceat(_SMALL[raw], start) if len(start) else start
    loud = (small == 0) & upper
    beside = np.zeros(len(token) + 2, dtype=bool)
    beside[1:-1] = loud
    name = upper & ~opens & ~unit & ~(loud & (beside[:-2] | beside[2:]))
    for kind, held in ((_NUMBER, number), (_UNIT, unit), (_NAME, name)):
        token[held] = kind
    return token, np.where(number | unit | name, value, np.uint64(0)), text


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """`offsets` and both ends of every character of a script without spaces:
    Thai to Khmer's neighbours, kana and Chinese characters, by their bytes."""
    if not (raw >= 0xE0).any():
        return offsets
    second = np.append(raw[1:], 0)
    three = ((raw >= 0xE3) & (raw <= 0xE9) & ~((raw == 0xE3) & (second == 0x80))) | ((raw == 0xE0) & (second >= 0xB8) & (second <= 0xBB))
    four = (raw == 0xF0) & (second >= 0xA0) & (second <= 0xB2)
    at, far = np.flatnonzero(three), np.flatnonzero(four)
    return np.unique(np.concatenate([offsets, at, at + 3, far, far + 4]).clip(0, len(raw)))


def _unit_hashes() -> np.ndarray:
    raw, offsets = shingles.column_bytes(pa.array(UNITS))
    return shingles.words(raw, offsets)[0]


_UNIT_HASHES = _unit_hashes()


def windows(
    texts: pa.Array, wanted: np.ndarray | None = None, short: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, plain, width, hash, slots) of the template windows with enough plain
    words, and of the windows of words as they are (plain, no slots) that hold
    more than numbers; or of those that the Bloom filter `wanted` may hold.

    Besides, without a filter, a text that has no window gives those of all its
    words as they are, or itself if it is shorter than a window; with a filter,
    every text gives all windows of the lengths in `short`. These have their
    length as `width`, the others 0."""
    raw, offsets = shingles.column_bytes(texts)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int64))
    parts = [none]
    for low, high in shingles.slices(offsets):
        own = offsets[low : high + 1]
        token, value, text = template(raw[own[0] : own[-1]], own - own[0])
        as_is = np.where(value == 0, token, value)
        first = np.searchsorted(text, np.arange(high - low))
        counts = np.diff(np.append(first, len(text)))
        seen = np.zeros(high - low, dtype=bool)

        def exact(width: int, of: np.ndarray) -> None:
            """Windows of `width` words of the texts marked in `of`."""
            at = np.flatnonzero(of[text[: len(text) - width + 1]] & (text[: len(text) - width + 1] == text[width - 1 :]))
            whole = np.full(len(at), int(_PLAIN) + width, dtype=np.uint64)
            for k in range(width):
                whole += as_is[at + k] * np.uint64(pow(_SCALE, k + 1, 1 << 64))
            window = shingles.mix(shingles.mix(whole)).view(np.int64)
            if wanted is not None:
                held = maybe_in(wanted, window)
                at, window = at[held], window[held]
            blank = np.zeros((len(at), WINDOW), np.int64)
            parts.append((text[at] + low, at - first[text[at]], np.full(len(at), True), np.full(len(at), width), window, blank))

        n = len(token) - WINDOW + 1
        for width in short:
            if len(token) >= width:
                exact(width, counts >= width)
        if n <= 0:
            if wanted is None:
                for width in range(1, WINDOW):
                    if len(token) >= width:
                        exact(width, counts == width)
            continue
        inside = text[:n] == text[WINDOW - 1 :]
        anchors = np.concatenate([[0], np.cumsum(value == 0)])
        numbers = np.concatenate([[0], np.cumsum(token == _NUMBER)])
        typed = inside & (anchors[WINDOW:] - anchors[:-WINDOW] >= ANCHORS)
        worded = inside & (numbers[WINDOW:] - numbers[:-WINDOW] < WINDOW)
        for plain, words, take in ((False, token, typed), (True, as_is, worded)):
            whole = np.full(n, _PLAIN if plain else 0, dtype=np.uint64)
            for k in range(WINDOW):
                whole += words[k : n + k] * np.uint64(pow(_SCALE, k + 1, 1 << 64))
            window = shingles.mix(whole).view(np.int64)
            if wanted is not None:
                take = take & maybe_in(wanted, window)
            at = np.flatnonzero(take)
            seen[text[at]] = True
            slots = value[at[:, None] + np.arange(WINDOW)].view(np.int64)
            if plain:
                slots = np.zeros_like(slots)
            parts.append((text[at] + low, at - first[text[at]], np.full(len(at), plain), np.zeros(len(at), np.int64), window[at], slots))
        if wanted is None:
            for width in range(1, WINDOW + 1):
                exact(width, ~seen & (counts == width if width < WINDOW else counts >= width))
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _window_rows(rows: DataFrame, wanted: np.ndarray | None, short: tuple[int, ...] = ()) -> DataFrame:
    """(id, key, at, plain, window, slots) of all windows of (id, key, text), or of those
    that the Bloom filter `wanted` may hold, as `windows` has them."""
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = None if shared is None else shared.value
            text, place, plain, width, window, slots = windows(batch.column("text"), bits, short)
            ids, keys = (batch.column(c).take(pa.array(text)) for c in ("id", "key"))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(text) + 1, dtype=np.int32) * WINDOW), pa.array(slots.ravel())
            )
            columns = [ids, keys, pa.array(place, pa.int32()), pa.array(plain), pa.array(width, pa.int32()), pa.array(window), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return rows.mapInArrow(run, _DDL)


def _keyed(table: DataFrame, key: Column, text: str) -> DataFrame:
    name = key.cast("long")
    return table.select(
        name.alias("id"), F.xxhash64(name, F.col(text)).alias("key"), F.col(text).alias("text")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    least_words: int = 1,
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, key (of
    doc_id and text), item_id, windows, item_windows, share, reparameterised.

    `windows` of the item's `item_windows` stand in the document in places with
    consistent slots; `share` is at least `CONTAINED`, or `RUN` windows stand one
    after the other as in the item. Template windows and
    windows of the words as they are count apart: the figures are of those with
    the larger share. `reparameterised`: some slot holds another value than in
    the item. Items of fewer words than a window, but of `least_words`, and of
    numbers only are held where all their words stand as in the item. Null and
    empty texts hold nothing and are held by nothing; repeated rows give one row.
    """
    items = _window_rows(_keyed(benchmark, F.col(item_id), text).distinct(), None)
    rank = F.row_number().over(Window.partitionBy("key", "plain").orderBy("at"))
    items = written(
        items.where((F.col("width") == 0) | (F.col("width") >= least_words)).select(
            rank.alias("rank"),
            F.col("id").alias("item_id"),
            F.col("key").alias("item_key"),
            F.col("at").alias("item_at"),
            "plain",
            "width",
            "window",
            F.col("slots").alias("item_slots"),
        ),
        "item-windows",
    )
    wanted = bloom_filter(items, "window")
    short = tuple(sorted(r["width"] for r in items.where("width > 0").select("width").distinct().collect()))
    found = _window_rows(_keyed(docs, F.col(doc_id), text), wanted, short).drop("plain", "width")
    pairs = F.filter(
        F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0
    )
    runs = (
        found.join(items, "window")
        .groupBy("id", "key", "item_id", "item_key", "plain", (F.col("at") - F.col("item_at")).alias("lag"))
        .agg(
            F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
            F.collect_set(F.struct("plain", "item_at", "rank")).alias("places"),
        )
        .where(F.size("pairs") == F.size(F.array_distinct("pairs.item_slots")))
    )
    # Windows that a text holds are neighbours if no window of the item of their kind lies between.
    ordered = F.array_sort("places")
    long = F.exists(
        F.sequence(F.lit(RUN - 1), F.size("_ordered") - 1),
        lambda i: (F.get("_ordered", i)["plain"] == F.get("_ordered", i - (RUN - 1))["plain"])
        & (F.get("_ordered", i)["rank"] - F.get("_ordered", i - (RUN - 1))["rank"] == RUN - 1),
    )
    runs = runs.withColumn("_ordered", ordered).withColumn(
        "long", F.when(F.size("_ordered") >= RUN, long).otherwise(False)
    )
    held = (
        runs.select(
            "long",
            "id",
            "key",
            "item_id",
            "item_key",
            F.explode("places").alias("place"),
            F.exists("pairs", lambda x: x["slots"] != x["item_slots"]).alias("other"),
        )
        .select(
            "id",
            "key",
            "item_id",
            "item_key",
            "long",
            "place.plain",
            F.col("place.item_at").alias("place"),
            (F.col("other") & ~F.col("place.plain")).alias("other"),
        )
        .groupBy("id", "key", "item_id", "item_key", "plain", "place")
        .agg(F.min("other").alias("other"), F.max("long").alias("long"))
        .groupBy("id", "key", "item_id", "item_key", "plain")
        .agg(F.count("*").alias("windows"), F.max("other").alias("reparameterised"), F.max("long").alias("long"))
    )
    sizes = items.groupBy("item_key", "plain").agg(
        F.count_distinct("item_at").alias("item_windows"), (F.max("width") > 0).alias("exact")
    )
    share = F.col("windows") / F.col("item_windows")
    best = F.max(F.struct(share.alias("share"), "windows", "item_windows")).alias("best")
    return (
        held.join(sizes, ["item_key", "plain"])
        .where(F.when(F.col("exact"), share == 1).otherwise((share >= CONTAINED) | F.col("long")))
        .groupBy(F.col("id").alias("doc_id"), "key", "item_id")
        .agg(best, F.min("reparameterised").alias("reparameterised"))
        .select("doc_id", "key", "item_id", "best.windows", "best.item_windows", "best.share", "reparameterised")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those that hold a benchmark item; columns as they are. Items
    of fewer words than a window are passed over: they stand in clean texts too."""
    key, bad = unique_name(docs, "key"), unique_name(docs, "bad")
    held = contaminated(docs, benchmark, doc_id, text=text, least_words=WINDOW).select(F.col("key").alias(bad)).distinct()
    marked = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), F.col(text)))
    kept = marked.join(held, F.col(key) == F.col(bad), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
