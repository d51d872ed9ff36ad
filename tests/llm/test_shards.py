import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import shards


def smallest_capacity(sizes, k):
    """Smallest largest shard of any contiguous partition into k, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(k - 1):
        best = [
            min((max(best[j], ends[i] - ends[j]) for j in range(i + 1)), default=0)
            for i in range(len(ends))
        ]
    return best[-1]


@pytest.mark.parametrize("seed,entries", [(1, 4), (2, 8), (3, 1 << 12)])
def test_cuts_are_minimax(spark, monkeypatch, seed, entries):
    monkeypatch.setattr(shards, "_ENTRIES", entries)
    rng = random.Random(seed)
    rows = sorted({rng.getrandbits(60): rng.choice([1, 5, 60, 300]) for _ in range(70)}.items())
    groups = spark.createDataFrame(rows, "position long, size long")
    capacity, cuts = shards.minimax_cuts(groups, 6)
    assert capacity == smallest_capacity([s for _, s in rows], 6)
    edges = [0, *cuts, 1 << 60]
    loads = [sum(s for p, s in rows if a <= p < b) for a, b in zip(edges, edges[1:])]
    assert sum(loads) == sum(s for _, s in rows) and max(loads) == capacity


def test_documents(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 90))) for _ in range(400)]
    rows = [(i, rng.choice(texts), 1) for i in range(800)] + [(800, None, 2), (801, None, 3), (None, "", 4), (900, "x", 1), (900, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shards.shard_documents(docs).collect()
    assert len(out) == len(rows)
    homes, loads = {}, [0] * 16
    for r in out:
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())
    by_id = {r["doc_id"]: r for r in out}
    for i, t, _ in rows:
        assert by_id[i]["size"] == len((t or "").encode()) + 1
        assert by_id[i]["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    for shard in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = {}
    for i, t, _ in rows:
        sizes[t] = sizes.get(t, 0) + len((t or "").encode()) + 1
    assert max(loads) - sum(loads) / 16 <= max(sizes.values())


def test_hot_group_has_its_own_shard(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text number {i}") for i in range(600)]
    out = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    loads = dict(out.groupBy("shard").agg(F.sum("size")).collect())
    hot = loads.pop(0)
    assert hot == 200 * 10 and len(loads) == 15
    assert max(loads.values()) - min(loads.values()) <= 15 * 20


def test_empty(spark):
    assert shards.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
