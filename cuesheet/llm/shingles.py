"""Hashes of word shingles, computed on the bytes of whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes, small enough for a core's cache;
    a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = max(start + 1, min(end, n))
        yield start, end
        start = end


def words(
    raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, text) of every word: a run of `solid` bytes, by default
    those other than ASCII white space. Words do not cross into the next text."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    solid = ~_SPACE[raw] if solid is None else solid
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    bits = n.bit_length()
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers(_INVERSE, bits)[starts])
    text = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, starts, text


def runs(hashes: np.ndarray, text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every `width` neighbouring words of one text; a
    text with fewer words gives one run of all of them."""
    n = len(hashes)
    scale = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(width)]
    first = np.flatnonzero(text[: n - width + 1] == text[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        out += hashes[first + k] * scale[k]
    own, begin, size = np.unique(text, return_index=True, return_counts=True)
    short = size < width
    rest = np.zeros(int(short.sum()), dtype=np.uint64)
    for k in range(width - 1):
        has = size[short] > k
        rest[has] += hashes[begin[short][has] + k] * scale[k]
    at = np.concatenate([first, begin[short]])
    value = mix(np.concatenate([out, rest + np.uint64(width)]))
    order = np.argsort(at, kind="stable")
    return at[order], value[order]
