"""A Bloom filter of fixed size over 64-bit keys, to thin rows out before a shuffle.

The filter has the same size for every corpus, so it may be sent to every
executor. Where it is full it lets everything pass: an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
_PROBES = (0, 24)


def bloom_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of a long column, as words of 64 bits: 2 MB."""
    at = F.explode(
        F.array(*[F.shiftright(F.col(key), s).bitwiseAND(F.lit(BITS - 1)) for s in _PROBES])
    )
    bit = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    words = (
        keys.select(at.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys the filter may hold."""
    found = np.ones(len(keys), dtype=bool)
    for s in _PROBES:
        at = (keys >> s) & (BITS - 1)
        found &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return found
