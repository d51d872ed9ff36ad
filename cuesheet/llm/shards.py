"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents of equal text form one group, which no cut splits. The groups stand
in a fixed order (by digest of the text; groups that fill a shard on their own
come first), and the cuts are those of the smallest capacity at which filling
shards greedily needs no more shards than there are. The capacity is found by
binary search.

Group sizes are never gathered. The driver sees sums over at most
`_ENTRIES` ranges of the order, narrows the search with them as far as they
decide it, and asks for finer sums of only those ranges in which a cut can
still fall. Each round narrows these ranges further, until they are groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import blocks_for, with_running_total, written

# The order of groups: the leading 60 bits of the MD5 of the text.
_BITS = 60
_NULL_TEXT = (1 << _BITS) - 1
# Ranges whose sums the driver holds after the first round, and adds per round.
_ENTRIES = 1 << 12


@dataclass
class Ranges:
    """Sums over consecutive ranges of the order, as far as they are known."""

    low: np.ndarray  # first position of the range
    width: np.ndarray  # positions in it
    size: np.ndarray  # total size of its groups
    atom: np.ndarray  # whether it holds one group only


def group_order(text: Column) -> Column:
    """Position of a text's group: equal texts share it, null comes last."""
    head = F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")
    return F.coalesce(head, F.lit(_NULL_TEXT))


def _sums(
    groups: DataFrame, spans: list[tuple[int, int]], widest: int
) -> list[tuple[int, int, int, bool]]:
    """(low, width, size, atom) of the non-empty ranges into which `spans`,
    given as (first position, end), are cut: into `_ENTRIES` in all, or finer
    where that is needed to come below a quarter of `widest`, the last width."""
    at = F.col("position")
    parts = max(4, _ENTRIES // len(spans)).bit_length() - 1
    most = max(0, widest.bit_length() - 3)
    width = [max(0, min(most, (end - first - 1).bit_length() - parts)) for first, end in spans]
    span, number = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, ((first, end), bits) in enumerate(zip(spans, width)):
        inside = (at >= first) & (at < end)
        span = F.when(inside, F.lit(i)).otherwise(span)
        number = F.when(inside, F.shiftright(at - first, bits)).otherwise(number)
    found = (
        groups.select(span.alias("span"), number.alias("range"), "position", "size")
        .where(F.col("span").isNotNull())
        .groupBy("span", "range")
        .agg(F.sum("size").alias("size"), F.min(at).alias("low"), F.max(at).alias("high"))
    )
    out = []
    for r in found.collect():
        atom = r["low"] == r["high"]
        bits = width[r["span"]]
        low = r["low"] if atom else spans[r["span"]][0] + (r["range"] << bits)
        out.append((low, 1 if atom else 1 << bits, r["size"], atom))
    return out


def _ranges(rows: list[tuple[int, int, int, bool]]) -> Ranges:
    rows = sorted(rows)
    return Ranges(
        np.array([r[0] for r in rows], dtype=np.int64),
        np.array([r[1] for r in rows], dtype=np.int64),
        np.array([r[2] for r in rows], dtype=np.int64),
        np.array([r[3] for r in rows], dtype=bool),
    )


def _fill(known: Ranges, ends: np.ndarray, capacity: int, fluid: bool) -> tuple[int | None, list[int]]:
    """Shards that greedy filling needs, and where each but the last ends.

    `fluid` lets a cut fall anywhere inside a range of several groups, which
    no true partition beats; otherwise ranges are whole, which a true
    partition always allows. None: a whole range exceeds the capacity.
    """
    cuts: list[int] = []
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while total - at > capacity:
        target = at + capacity
        i = int(np.searchsorted(ends, target, side="right"))  # range i passes the target
        start = int(ends[i - 1]) if i else 0
        step = target if fluid and not known.atom[i] else start
        if step <= at:
            return None, cuts
        at = step
        cuts.append(at)
    return len(cuts) + 1, cuts


def _smallest(known: Ranges, ends: np.ndarray, shards: int, fluid: bool) -> int:
    low, high = 0, int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        needed, _ = _fill(known, ends, middle, fluid)
        if needed is not None and needed <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first position of every shard but the
    first, for groups (position, size) in order of position.

    An empty table gives capacity 0 and no cuts; fewer groups than shards
    leave the last shards empty.
    """
    known = _ranges(_sums(groups, [(0, 1 << _BITS)], 1 << _BITS))
    while len(known.size):
        ends = np.cumsum(known.size)
        least = _smallest(known, ends, shards, fluid=True)
        most = _smallest(known, ends, shards, fluid=False)
        _, upper = _fill(known, ends, most, fluid=True)
        lower, at = [], 0
        for _ in range(shards - 1):
            i = int(np.searchsorted(ends, at + least, side="right"))
            at = max(at, int(ends[i - 1]) if i else 0)
            lower.append(at)
        upper += [int(ends[-1])] * (shards - 1 - len(upper))
        starts = ends - known.size
        open_ = any(
            ((starts <= b) & (ends >= a) & ~known.atom).any() for a, b in zip(lower, upper)
        )
        if not open_:
            _, cuts = _fill(known, ends, most, fluid=False)
            return most, [int(known.low[np.searchsorted(ends, c, side="right")]) for c in cuts]
        # One span for every run of ranges that a cut can touch: one per cut at most.
        spans, widest = [], 0
        for a, b in zip(lower, upper):
            touched = np.flatnonzero((starts <= b) & (ends >= a) & ~known.atom)
            if len(touched):
                low, high = touched[0], touched[-1]
                widest = max(widest, int(known.width[touched].max()))
                first, end = int(known.low[low]), int(known.low[high] + known.width[high])
                if spans and first < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((first, end))
        kept = np.ones(len(ends), dtype=bool)
        for first, end in spans:
            kept &= (known.low < first) | (known.low >= end)
        known = _ranges(
            [*zip(*(x[kept].tolist() for x in (known.low, known.width, known.size, known.atom)))]
            + _sums(groups, spans, widest)
        )
    return 0, []


def full_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(position, size) of the groups that fill a shard on their own: those at
    least as large as an equal share of what the others leave. At most `shards`."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    largest = groups.orderBy(F.desc("size"), "position").limit(shards).collect()
    full: list[tuple[int, int]] = []
    for row in largest:
        left = shards - len(full)
        if left <= 1 or row["size"] * left < total:
            break
        full.append((row["position"], row["size"]))
        total -= row["size"]
    return full


def shard_documents(
    docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the number of UTF-8 bytes of the text plus 1 (null text: 1), and
    law `bytes` keeps the sizes of shards near equal. Equal texts share a shard;
    so do all null texts. `slot` numbers the rows of a shard without gaps from
    0. `grown_shard` is null. Repeated rows are rows of their own; an empty
    table gives an empty result; other columns are ignored.
    """
    raw = F.encode(F.col(text), "UTF-8")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        group_order(F.col(text)).alias("position"),
    )
    rows = written(rows, "shard-rows")
    groups = written(
        rows.groupBy("position").agg(F.sum("size").alias("size")), "shard-groups"
    )
    full = full_groups(groups, shards)
    alone = [position for position, _ in full]
    rest = groups.where(~F.col("position").isin(alone)) if alone else groups
    _, cuts = minimax_cuts(rest, shards - len(full))
    shard = F.lit(len(full))
    for cut in cuts:
        shard = shard + (F.col("position") >= cut).cast("int")
    if alone:
        own = F.array_position(F.array(*[F.lit(p) for p in alone]), F.col("position"))
        shard = F.when(F.col("position").isin(alone), own.cast("int") - 1).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks_for(rows.count())))
    slotted = with_running_total(
        placed, ["shard"], block, [F.col("doc_id"), F.col("text_crc32")], F.lit(1), "slot"
    )
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
