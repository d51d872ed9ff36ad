import hashlib
import math
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from cuesheet.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, row int"


def shared(sizes):
    """Targets by sharing again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: Fraction(2 * sizes[s]) for s in above}
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        source = rng.choice(["a", "b", "c", "é", "Z", None] + ["hot"] * 4)
        text = rng.choice([None, "", " \t\n", "w " * rng.randint(1, 400)])
        rows.append((i, text, source, 0, 0))
    return rows + [(7, rows[7][1], rows[7][2], 0, 0), (None, "x y", "tiny", 0, 0)]


def test_mix_against_plain_loop(spark):
    rows = made()
    sizes, docs = {}, {}
    for i, t, s, *_ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        key = hashlib.md5(f"{'' if i is None else i}:{n}".encode()).hexdigest()
        docs.setdefault(s, []).append((key, i, n))
    targets = shared(sizes)
    expected = []
    for s, own in docs.items():
        words, at = math.floor(float(targets[s])), 0
        for key, i, n in sorted(own, key=lambda x: x[0]):
            taken = sum(1 for e in range(3) for p in range(at, at + n) if e * sizes[s] + p < words)
            expected.append((i, n, sizes[s], taken))
            at += n
    out = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.size, r.source_size, r.taken) for r in out], key=key) == sorted(expected, key=key)
    assert sum(t for *_, t in expected) <= 1.5 * sum(sizes.values())
    for r in out:
        assert r.taken <= 2 * r.size


def test_schedule_is_even(spark):
    sizes = [("a", 90_000), ("b", 30_000), ("c", 500), ("d", 0)]
    sources = mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"))
    slots = mixing.schedule(sources, 100).orderBy("slot").collect()
    totals = {r.number: 0 for r in slots}
    share = {n: sum(r.number == n for r in slots) / len(slots) for n in totals}
    for i, r in enumerate(slots, 1):
        totals[r.number] += 1
        for n, seen in totals.items():
            assert abs(seen - share[n] * i) < 8
    taken = {n: sum(min(r.limit, 100) for r in slots if r.number == n) for n in totals}
    for r in sources.collect():
        if r.source_size % 100 == 0 and r.source_size:
            assert taken[r.number] == math.floor(r.target)


def test_corpus_repeats_whole_documents(spark):
    docs = spark.createDataFrame([r for r in made() if r[0] != 7], SCHEMA)
    out = mixing.mixed_corpus(docs)
    assert out.columns == docs.columns
    counts = dict(out.groupBy("doc_id").count().collect())
    assert set(counts.values()) <= {1, 2} and 2 in counts.values()
    sums = dict(out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect())
    for r in mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        assert abs((sums[r.source] or 0) - r.target) <= 400


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(docs).count() == 0
    assert mixing.mixed_corpus(docs).count() == 0


def test_points_of_large_schedules(spark):
    golden = math.isqrt(5 << 200)  # the square root of 5, times 2^100
    inverse = (golden - (1 << 100)) << 47 >> 100  # 2^48 divided by the golden ratio
    assert mixing._GOLDEN in (inverse, inverse + 1)
    rng = random.Random(9)
    for slots in (1, 7, 4_000_000_000 // 3, (1 << 36) - 1):
        ids = [0, 1, 3 * slots - 1] + [rng.randrange(3 * slots) for _ in range(200)]
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        got = df.select("id", mixing.point_unit(F.col("id"), slots).alias("unit")).collect()
        assert all(r.unit == (r.id * mixing._GOLDEN % (1 << 48)) * slots >> 48 for r in got)


def test_long_sources_are_made_in_spans(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 7)
    sources = mixing.source_targets(spark.createDataFrame([("a", 50_000), ("b", 9_999)], "source string, source_size long"))
    short = mixing.schedule(sources, 100).orderBy("slot").collect()
    monkeypatch.undo()
    assert short == mixing.schedule(sources, 100).orderBy("slot").collect()
