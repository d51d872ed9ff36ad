import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cuesheet.llm import neardup, shingles
from cuesheet.llm.bloom import bloom_filter, maybe_in

SCHEMA = "doc_id long, text string, node string, label int"


def vector_of(text):
    w = text.split(" ")
    w = [x for x in w if x]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
    return collections.Counter(runs)


def brute_classes(texts):
    """Classes of distinct texts by comparing every pair in full."""
    vectors = [vector_of(t) for t in texts]
    df = collections.Counter(s for v in vectors for s in v)
    idf = lambda n: 1 + math.log10(1 + math.log(max(len(texts) / 2 ** (round(8 * math.log2(n)) / 8), 1)))
    weighted = [{s: (1 + math.log(c)) * idf(df[s]) for s, c in v.items()} for v in vectors]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(weighted):
        for j in range(i):
            b = weighted[j]
            shared = sum(min(x, b[s]) for s, x in a.items() if s in b)
            if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    make = lambda n: [word() for _ in range(n)]
    passage = make(60)
    texts = [make(rng.randint(1, 150)) for _ in range(60)] + [make(50) + passage for _ in range(20)]
    base = make(200)
    for edits in (1, 2, 3, 8, 9, 30):
        for _ in range(25):
            copy = base[:]
            for i in rng.sample(range(200), edits):
                copy[i] = word()
            texts.append(copy)
    for t in texts[:30]:
        texts.append(t + [word()])
    return [" ".join(t) for t in texts]


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = list(dict.fromkeys(corpus()))
    expected = brute_classes(texts)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    copies = [(1000 + i, texts[i % 7], "x", 1) for i in range(40)]
    odd = [(2000, None, "x", 1), (2001, None, "x", 1), (2002, "", "x", 1), (2003, " \n", "x", 1), (0, texts[0], None, None)]
    docs = spark.createDataFrame(rows + copies + odd, SCHEMA)
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    found = {r.doc_id: r.class_id for r in out}
    assert all(found[i] == i for i in (2000, 2001, 2002, 2003))
    assert all(found[1000 + i] == found[i % 7] for i in range(40))
    smallest = {}
    for i, c in enumerate(expected):
        smallest.setdefault(c, i)
    assert [found[i] for i in range(len(texts))] == [smallest[c] for c in expected]

    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted([*smallest.values(), 2000, 2001, 2002, 2003])


def test_small_families_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for family in range(200):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for k in range(1 + family % 3):  # each copy edited in a stretch of its own
            copy = base[:]
            for i in range(60 * k, 60 * k + rng.randint(10, 22)):
                copy[i] = word()
            texts.append(" ".join(copy))
    expected = brute_classes(texts)
    smallest = {}
    for i, c in enumerate(expected):
        smallest.setdefault(c, i)
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [smallest[c] for c in expected]


def test_samples_agree_as_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.95):
        agree, exact = [], []
        for _ in range(30):
            common = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
            size = int(400 * share)
            other = rng.integers(1, 1 << 63, 400 - size, dtype=np.uint64)
            weight = rng.uniform(1, 3, 400)
            a = (common, weight)
            b = (np.append(common[:size], other), np.append(weight[:size], rng.uniform(1, 3, 400 - size)))
            both = []
            for v, w in (a, b):
                order = np.argsort(v)
                both.append(neardup.weighted_samples(v[order], np.array([0]), w[order])[0])
            agree.append(float((both[0] == both[1]).mean()))
            exact.append(neardup.weighted_jaccard(a, b))
        assert abs(np.mean(agree) - np.mean(exact)) < 0.03


def test_pack_round_trips():
    values = np.unique(np.random.default_rng(4).integers(1 << 40, 1 << 44, 500, dtype=np.uint64))
    assert (neardup._unpack(neardup._pack(values, 1 << 40), 1 << 40) == values).all()
    order = np.random.default_rng(5).permutation(50).astype(np.uint64) << np.uint64(33)
    v, w = neardup.unpack_vector(neardup.pack_vector(order & neardup._KEEP, np.ones(50), np.arange(50.0)))
    assert len(v) == 50 and w.sum() == np.arange(50).sum() and (np.diff(v.astype(np.int64)) >= 0).all()


def test_words_and_runs():
    texts = ["a b  c", None, "", "x", "a b c d e f", " \n é à ", "a b c d e"]
    raw, offsets = shingles.column_bytes(pa.array(["skip", *texts]).slice(1))
    hashes, starts, text = shingles.words(raw, offsets)
    assert [(int(t), len((texts[t] or "").encode()[s - offsets[t] :].split()[0])) for s, t in zip(starts, text)][:3] == [(0, 1)] * 3
    assert collections.Counter(text.tolist()) == {0: 3, 3: 1, 4: 6, 5: 2, 6: 5}
    at, value = shingles.runs(hashes, text)
    by_text = [value[text[at] == i].tolist() for i in range(len(texts))]
    assert [len(x) for x in by_text] == [1, 0, 0, 1, 2, 1, 1] and by_text[4][0] == by_text[6][0]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(101, 100), (100, 102), (7, 7)]
    found = dict(neardup.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100}


def test_bloom(spark):
    keys = [(-5,), (1 << 60,), (12345,)]
    bits = bloom_filter(spark.createDataFrame(keys, "k long"), "k")
    assert maybe_in(bits, np.array([-5, 1 << 60, 12345], dtype=np.int64)).all()
    assert maybe_in(bits, np.arange(1000, dtype=np.int64) * 7919 << 20).sum() < 3


@pytest.mark.parametrize("rows", [[], [(1, None, "", 0)], [(1, "only one", "", 0)]])
def test_few(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert neardup.near_duplicates(docs).count() == len(rows)
    assert neardup.without_near_duplicates(docs).count() == len(rows)
