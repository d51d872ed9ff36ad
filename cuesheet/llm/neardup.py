"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

1. Equal texts are one node, named by the hash of the text. Nodes are dealt
   into chunks of some megabytes.
2. Document frequencies: every chunk sends its distinct shingle hashes, sorted
   and stored as differences, to buckets of the hash range; each bucket counts
   in how many chunks' texts a shingle stands and answers every chunk.
3. Every node draws `SAMPLES` weighted samples (improved consistent weighted
   sampling): two nodes agree on a sample with the probability of their
   weighted Jaccard similarity. Bands of samples give buckets.
4. Each node is compared exactly with one leader of its buckets. Nodes that
   this leaves apart in a bucket are compared with all others there, block by
   block, so that no link that a bucket holds is lost; linked nodes form classes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm import shingles
from cuesheet.llm.bloom import bloom_filter, maybe_in
from cuesheet.llm.common import unique_name, written

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
CHUNK_BYTES = 4 << 20
# Nodes, and entries of their vectors, that a block of a bucket holds on average.
BLOCK, BLOCK_ENTRIES = 256, 200_000
# Bits of a shingle hash that its bucket does not already tell.
_VALUE_BITS = 36
_FILL = 0xFFFFFFFF
_TABLE_BITS = 16
_KEEP = np.uint64((1 << 40) - 1)


def node_of(text: Column) -> Column:
    """Hash of a text that has words, else null."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def distinct_texts(docs: DataFrame, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(node, text) of the texts with words, repeats within a task left out;
    with `wanted`, a Bloom filter, only of nodes that it may hold."""
    rows = docs.select(node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            take = np.ones(len(nodes), dtype=bool)
            if shared is not None:
                take &= maybe_in(shared.value, nodes)
            at = []
            for i in np.flatnonzero(take).tolist():
                if nodes[i] not in seen:
                    seen.add(nodes[i])
                    at.append(i)
            yield batch.take(pa.array(at, pa.int64()))

    return rows.where(F.col("node").isNotNull()).mapInArrow(run, rows.schema)


# --- document frequencies ---------------------------------------------------


def _distinct(table: pa.Table) -> pa.Table:
    """One row per node of a chunk."""
    nodes = table.column("node").to_numpy()
    _, first = np.unique(nodes, return_index=True)
    return table.take(pa.array(np.sort(first)))


def _shingled(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of every text of a table."""
    raw, offsets = shingles.column_bytes(table.column("text"))
    values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in shingles.slices(offsets):
        own = offsets[low : high + 1]
        hashes, _, text = shingles.words(raw[own[0] : own[-1]], own - own[0])
        at, value = shingles.runs(hashes, text)
        values.append(value)
        rows.append(text[at] + low)
    return np.concatenate(values), np.concatenate(rows)


def _shift(buckets: int) -> int:
    return max(0, 64 - _VALUE_BITS - (buckets - 1).bit_length())


def _by_hash(
    value: np.ndarray, row: np.ndarray, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows in order of hash, the number of each hash's shortened
    form among the distinct ones, and these, sorted."""
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    short = value >> np.uint64(_shift(buckets))
    new = np.ones(len(short), dtype=bool)
    new[1:] = short[1:] != short[:-1]
    return value, row, np.cumsum(new) - 1, short[new]


def _edges(buckets: int) -> np.ndarray:
    span = 1 << (64 - _shift(buckets))
    return np.array([-(-span * b // buckets) for b in range(buckets + 1)], dtype=np.uint64)


def _pack(sorted_values: np.ndarray, base: int) -> bytes:
    """Differences of sorted numbers as 32-bit words; a full word only adds."""
    steps = np.diff(sorted_values, prepend=np.uint64(base))
    fills = (steps // np.uint64(_FILL)).astype(np.int64)
    out = np.full(len(steps) + int(fills.sum()), _FILL, dtype=np.uint32)
    out[np.cumsum(fills + 1) - 1] = (steps % np.uint64(_FILL)).astype(np.uint32)
    return out.tobytes()


def _unpack(blob: bytes, base: int) -> np.ndarray:
    words = np.frombuffer(blob, dtype=np.uint32)
    total = np.cumsum(words.astype(np.uint64)) + np.uint64(base)
    return total[words != _FILL]


def _with_codes(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, codes): for the distinct shingles of every chunk, in
    order, 8 times the binary logarithm of their document frequency."""
    edges = _edges(buckets)

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = _distinct(table)
        value, row = _shingled(table)
        _, row, rank, short = _by_hash(value, row, buckets)
        own = np.searchsorted(short, edges)
        # Each shingle once per text that holds it: its rows are in order.
        once = np.ones(len(row), dtype=bool)
        once[1:] = (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])
        counts = np.bincount(rank[once], minlength=len(short))
        out: dict[str, list] = {"bucket": [], "chunk": [], "values": [], "counts": []}
        for b in range(buckets):
            low, high = own[b], own[b + 1]
            if high > low:
                out["bucket"].append(b)
                out["chunk"].append(chunk)
                out["values"].append(_pack(short[low:high], int(edges[b])))
                out["counts"].append(zlib.compress(counts[low:high].astype(np.uint32).tobytes(), 1))
        return pa.table(out, schema=sent)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_unpack(v, int(edges[bucket])) for v in table.column("values").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(c), np.uint32) for c in table.column("counts").to_pylist()]
        value, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        frequency = np.bincount(inverse, np.concatenate(counts), minlength=len(value))
        code = np.round(8 * np.log2(frequency)).astype(np.uint8)[inverse]
        out: dict[str, list] = {"chunk": [], "bucket": [], "codes": []}
        at = 0
        for chunk, part in zip(table.column("chunk").to_pylist(), parts):
            own = code[at : at + len(part)]
            at += len(part)
            if own.any():
                out["chunk"].append(chunk)
                out["bucket"].append(bucket)
                out["codes"].append(zlib.compress(own.tobytes(), 1))
        return pa.table(out, schema=answered)

    sent = pa.schema(
        [("bucket", pa.int32()), ("chunk", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())]
    )
    answered = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary())])
    return (
        chunks.groupBy("chunk")
        .applyInArrow(send, "bucket int, chunk int, values binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(count, "chunk int, bucket int, codes binary")
    )


# --- weights and samples ----------------------------------------------------


def idf_table(texts: int) -> np.ndarray:
    """Inverse document frequency by code. It is damped, so that a copy whose
    edits are rare shingles still resembles its original."""
    frequency = 2.0 ** (np.arange(256) / 8)
    return 1 + np.log10(1 + np.log(np.maximum(texts / frequency, 1)))


def _vectors(
    value: np.ndarray, row: np.ndarray, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) of hashes in order, sorted by row and hash, with
    their ranks and 1 + ln(tf)."""
    small = row.astype(np.uint16) if not len(row) or row.max() < 1 << 16 else row
    order = np.argsort(small, kind="stable")
    value, row, rank = value[order], row[order], rank[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(value)))
    return value[at], row[at], rank[at], 1 + np.log(tf)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), shuffled: r, 1/r and ln c by 16 bits of a hash."""
    n = 1 << _TABLE_BITS
    grid = np.linspace(0, 40, 1 << 20)
    below = 1 - np.exp(-grid) * (1 + grid)
    gamma = np.interp((np.arange(n) + 0.5) / n, below, grid)
    r = np.random.default_rng(11).permutation(gamma)
    c = np.random.default_rng(12).permutation(gamma)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32)


_FACTORS = np.random.default_rng(13).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Shingles whose samples are drawn together: few enough for a core's cache.
_SAMPLED_AT_ONCE = 1 << 14


def weighted_samples(value: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(vector, sample) 32-bit samples of vectors that start at `starts`.

    For each shingle and sample, r and c (Gamma) and b (uniform) follow from
    the hash; t = floor(ln w / r + b), and the sample is the (shingle, t) of
    the smallest ln c - r (t - b + 1).
    """
    r_table, inverse, ln_c = _tables()
    log_w = np.log(weight).astype(np.float32)
    sizes = np.diff(np.append(starts, len(value)))
    out = np.empty((len(starts), SAMPLES), dtype=np.uint32)
    for low, high in shingles.slices(np.append(starts, len(value)), _SAMPLED_AT_ONCE):
        first = int(starts[low])
        last = first + int(sizes[low:high].sum())
        own, w = value[first:last], log_w[first:last]
        edges = starts[low:high] - first
        owner = np.repeat(np.arange(high - low), sizes[low:high])
        for j, factor in enumerate(_FACTORS):
            # Three fields of 16 bits choose r, c and b.
            field = (own * factor).view(np.uint16).reshape(-1, 4)
            i = field[:, 3].astype(np.intp)
            b = field[:, 1] * np.float32(2.0**-_TABLE_BITS)
            t = w * inverse.take(i)
            t += b
            np.floor(t, out=t)
            b -= t
            b -= np.float32(1)
            b *= r_table.take(i)
            b += ln_c.take(field[:, 2].astype(np.intp))
            least = np.minimum.reduceat(b, edges)
            at = np.flatnonzero(b == least.take(owner))
            if len(at) > len(edges):  # ties: the smallest hash
                whose = owner[at]
                at = at[np.append(True, whose[1:] != whose[:-1])]
            key = own[at] ^ (t[at].astype(np.int64).view(np.uint64) * _FACTORS[0])
            out[low:high, j] = shingles.mix(key) >> np.uint64(32)
    return out


def _band_keys(samples: np.ndarray) -> np.ndarray:
    """(vector, band) hashes of the samples of every band."""
    bands = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        key = shingles.mix(key ^ bands[:, :, k])
    return key.view(np.int64)


def _signatures(chunks: DataFrame, codes: DataFrame, buckets: int, texts: int) -> DataFrame:
    """(node, bands, entries, codes) of every node: `entries` counts its
    distinct shingles, `codes` are theirs in order of hash, null if each
    stands in no other text."""
    idf = idf_table(texts)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({name: [] for name in schema.names}, schema=schema)
        docs = _distinct(docs)
        value, row, rank, short = _by_hash(*_shingled(docs), buckets)
        edges = np.searchsorted(short, _edges(buckets))
        code = np.zeros(len(short), dtype=np.uint8)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()):
            code[edges[b] : edges[b + 1]] = np.frombuffer(zlib.decompress(blob), np.uint8)
        value, row, rank, tf = _vectors(value, row, rank)
        own = code[rank]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        bands = _band_keys(weighted_samples(value, starts, tf * idf[own]))
        ends = np.append(starts, len(value))
        blobs = [
            zlib.compress(own[a:b].tobytes(), 1) if own[a:b].any() else None
            for a, b in zip(ends, ends[1:])
        ]
        flat = pa.array(bands.ravel(), pa.int64())
        offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
        return pa.table(
            {
                "node": docs.column("node").take(pa.array(row[starts])),
                "bands": pa.ListArray.from_arrays(offsets, flat),
                "entries": np.diff(ends),
                "codes": pa.array(blobs, pa.binary()),
            },
            schema=schema,
        )

    schema = pa.schema(
        [
            ("node", pa.int64()),
            ("bands", pa.list_(pa.int64())),
            ("entries", pa.int64()),
            ("codes", pa.binary()),
        ]
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(codes.groupBy("chunk"))
        .applyInArrow(run, "node long, bands array<long>, entries long, codes binary")
    )


def _vector_blobs(texts: DataFrame, count: int) -> DataFrame:
    """(node, bands, vector) of (node, text, bands, codes): 40 bits of every
    distinct shingle hash, sorted, then tf and idf, compressed."""
    idf = idf_table(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            value, row, _, tf = _vectors(*_by_hash(*_shingled(table), 1)[:3])
            edges = np.searchsorted(row, np.arange(table.num_rows + 1))
            blobs = []
            for i, codes in enumerate(table.column("codes").to_pylist()):
                own = value[edges[i] : edges[i + 1]]
                code = np.zeros(len(own), np.uint8)
                if codes is not None:
                    code = np.frombuffer(zlib.decompress(codes), np.uint8)
                blobs.append(pack_vector(own & _KEEP, tf[edges[i] : edges[i + 1]], idf[code]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("bands"), pa.array(blobs, pa.binary())],
                names=["node", "bands", "vector"],
            )

    return texts.mapInArrow(run, "node long, bands array<long>, vector binary")


def pack_vector(value: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> bytes:
    order = np.argsort(value)
    value = value[order]
    high, low = (value >> np.uint64(32)).astype(np.uint8), value.astype(np.uint32)
    weight = (tf * idf)[order].astype(np.float32)
    return len(value).to_bytes(4, "little") + low.tobytes() + high.tobytes() + zlib.compress(weight.tobytes(), 1)


def unpack_vector(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    low = np.frombuffer(blob, np.uint32, n, 4).astype(np.uint64)
    high = np.frombuffer(blob, np.uint8, n, 4 + 4 * n).astype(np.uint64)
    return low | (high << np.uint64(32)), np.frombuffer(zlib.decompress(blob[4 + 5 * n :]), np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=False, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total > 0 else 0.0


# --- links and classes ------------------------------------------------------


def _with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, va, vb) of the pairs (a, b)."""
    return (
        pairs.join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
        .join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a")
        .select("a", "b", "va", "vb")
    )


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, va, vb) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = [
                weighted_jaccard(unpack_vector(x.as_py()), unpack_vector(y.as_py())) >= least
                for x, y in zip(batch.column("va"), batch.column("vb"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(take, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _block_links(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links between the two sides of a pair of blocks that join different
    labels, as many as it takes to connect the labels that any link of the
    blocks connects. A pair of nodes is left to the first band they share: as
    their labels differ, its bucket is scanned too or holds these two alone."""
    nodes = table.column("node").to_numpy()
    labels = table.column("label").to_numpy()
    left = table.column("left").to_numpy(zero_copy_only=False)
    right = table.column("right").to_numpy(zero_copy_only=False)
    band = table.column("band")[0].as_py()
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
    vectors = [unpack_vector(v) for v in table.column("vector").to_pylist()]
    totals = np.array([float(w.sum(dtype=np.float64)) for _, w in vectors])
    keys = np.concatenate([v for v, _ in vectors])
    weights = np.concatenate([w for _, w in vectors])
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v, _ in vectors])
    order = np.argsort(keys, kind="stable")
    keys, weights, owner = keys[order], weights[order], owner[order]
    edges = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    n = len(nodes)
    shared = np.zeros(n * n)
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            i = owner[a:b]
            small = np.minimum(weights[a:b, None], weights[None, a:b])
            shared[(i[:, None] * n + i[None, :]).ravel()] += small.ravel()
    shared = shared.reshape(n, n)
    alike = shared >= least * (totals[:, None] + totals[None, :] - shared)
    alike &= left[:, None] & right[None, :] & (labels[:, None] != labels[None, :])
    parent = {int(label): int(label) for label in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike)):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b and int(np.flatnonzero(bands[i] == bands[j])[0]) == band:
            parent[b] = a
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _blocks(nodes: str, entries: str) -> Column:
    """How many blocks the nodes of a bucket, with so many entries, make."""
    need = F.greatest(F.col(nodes) / BLOCK, F.coalesce(entries, F.lit(0)) / BLOCK_ENTRIES)
    return F.least(F.col(nodes), F.ceil(need)).alias(nodes)


def _residual_links(
    collisions: DataFrame, chosen: DataFrame, labels: DataFrame, vectors: DataFrame, least: float
) -> DataFrame:
    """(a, b) links that the comparison with the `chosen` leaders left open.

    In every bucket whose nodes carry several labels, nodes without the
    leader's label are compared with all others. Blocks of about `BLOCK` nodes
    and `BLOCK_ENTRIES` entries meet in pairs: no group of more than two blocks
    is ever in one place. The pair of a bucket of two is compared unless its
    leader was the chosen one.
    """
    labelled = collisions.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("main"))
    sided = labelled.join(of_leader, "leader", "left").withColumn(
        "open", F.col("label") != F.coalesce("main", "leader")
    )
    counts = sided.groupBy("band", "key").agg(
        F.count_if("open").alias("opened"),
        F.count_if(~F.col("open")).alias("closed"),
        F.sum(F.when(F.col("open"), F.col("entries"))).alias("open_entries"),
        F.sum(F.when(~F.col("open"), F.col("entries"))).alias("closed_entries"),
    )
    counts = counts.where(F.col("opened") > 0)
    both = F.col("opened") + F.col("closed") == 2
    twos = (
        sided.where("open")
        .join(counts.where(both), ["band", "key"])
        .select(F.col("node").alias("b"), F.col("leader").alias("a"))
        .distinct()
        .join(chosen.select(F.col("node").alias("b"), F.col("leader").alias("a")), ["a", "b"], "left_anti")
    )
    counts = counts.where(~both)
    counts = counts.select(
        "band", "key", _blocks("opened", "open_entries"), _blocks("closed", "closed_entries")
    ).withColumnsRenamed({"opened": "open_blocks", "closed": "closed_blocks"})
    rows = sided.select("band", "key", "node", "label", "open").join(counts, ["band", "key"])
    spot = F.xxhash64("node", F.lit(1))
    block = F.when(
        F.col("open"), F.pmod(spot, F.col("open_blocks"))
    ).otherwise(F.col("open_blocks") + F.pmod(spot, F.greatest("closed_blocks", F.lit(1))))
    others = F.when(
        F.col("open"), F.sequence(F.lit(0), F.col("open_blocks") + F.col("closed_blocks") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("open_blocks") - 1))
    dealt = (
        rows.withColumn("block", block.cast("long"))
        .withColumn("other", F.explode(others.cast("array<long>")))
        .select(
            "band",
            "key",
            "node",
            "label",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            (F.col("block") <= F.col("other")).alias("left"),
            (F.col("block") >= F.col("other")).alias("right"),
        )
    )

    def run(table: pa.Table) -> pa.Table:
        found = _block_links(table, least)
        return pa.table(
            {"a": [a for a, _ in found], "b": [b for _, b in found]},
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        )

    in_blocks = (
        dealt.join(vectors, "node")
        .groupBy("band", "key", "low", "high")
        .applyInArrow(run, "a long, b long")
    )
    return in_blocks.union(_compared(_with_vectors(twos, vectors), least))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (a, b): label is the smallest node of
    the component. Labels flow along links and jump to their label's label, so
    the number of rounds grows with the logarithm of the longest path."""
    both = written(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = written(
        both.groupBy("a")
        .agg(F.min("b").alias("b"))
        .select(F.col("a").alias("node"), F.least("a", "b").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        target = labels.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        new = written(
            moved.join(target, moved["next"] == target["of"], "left").select(
                "node",
                F.least("next", F.coalesce("jump", "next")).alias("label"),
                F.col("label").alias("old"),
            ),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def node_classes(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(node, label) of every node that is similar enough to another."""
    size, texts = (
        docs.select(F.octet_length(F.col(text)).alias("n"), node_of(F.col(text)).alias("node"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("node"))
        .first()
    )
    chunk_count = max(1, math.ceil(size / CHUNK_BYTES))
    chunks = distinct_texts(docs, text).withColumn(
        "chunk", F.pmod("node", F.lit(chunk_count)).cast("int")
    )
    codes = _with_codes(chunks, chunk_count)
    signatures = written(_signatures(chunks, codes, chunk_count, max(1, texts)), "signatures")
    banded = signatures.select("node", "entries", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n"))
    collisions = written(
        banded.join(shared.where(F.col("n") > 1).drop("n"), ["band", "key"]), "collisions"
    )
    nodes = collisions.select("node").distinct()
    wanted = bloom_filter(nodes, "node")
    near_texts = distinct_texts(docs, text, wanted).join(nodes, "node")
    once = near_texts.join(signatures, "node").dropDuplicates(["node"])
    vectors = written(_vector_blobs(once.select("node", "text", "bands", "codes"), max(1, texts)), "vectors")
    # The leader that most bands agree on, for every node that is not its own.
    votes = collisions.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    chosen = written(
        votes.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader")), "chosen"
    )
    pairs = _with_vectors(chosen.select(F.col("leader").alias("a"), F.col("node").alias("b")), vectors)
    links = written(_compared(pairs, least), "star-links")
    labels = components(links)
    more = written(_residual_links(collisions, chosen, labels, vectors, least), "more-links")
    if more.isEmpty():
        return labels
    return components(links.union(more))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its
    class) and class_size.

    Texts are compared by shingles of five words (fewer words: all of them).
    Equal texts are one class. A text that is null or has no word is a class
    of its own. Repeated rows are rows of one class; an empty table gives none.
    """
    labels = node_classes(docs, text, least)
    rows = docs.select(F.col(doc_id).alias("doc_id"), node_of(F.col(text)).alias("node"))
    named = (
        rows.where(F.col("node").isNotNull())
        .join(labels, "node", "left")
        .select("doc_id", F.coalesce("label", "node").alias("label"))
    )
    sizes = named.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    alone = rows.where(F.col("node").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return named.join(sizes, "label").select("doc_id", "class_id", "class_size").unionByName(alone)


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """`docs` with one document of every class: the one of the smallest doc_id."""
    labels = node_classes(docs, text, least)
    node, key, place = (unique_name(docs, c) for c in ("node", "key", "place"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), node_of(F.col(text)).alias("node"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    kept = (
        rows.where(F.col("node").isNotNull())
        .join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node"))
        .agg(F.min_by(F.struct("doc_id", "node"), first).alias("kept"))
        .select(F.xxhash64("kept.doc_id", "kept.node").alias("_kept"))
    )
    marked = docs.withColumn(node, node_of(F.col(text))).withColumn(
        key, F.xxhash64(F.col(doc_id), F.col(node))
    )
    # A repeated row stays once; the join has already brought such rows together.
    repeats = Window.partitionBy(key).orderBy(key)
    single = (
        marked.where(F.col(node).isNotNull())
        .join(kept, F.col(key) == F.col("_kept"))
        .withColumn(place, F.row_number().over(repeats))
        .where(F.col(place) == 1)
    )
    alone = marked.where(F.col(node).isNull())
    names = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*names).unionByName(alone.select(*names))
