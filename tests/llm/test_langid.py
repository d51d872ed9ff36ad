import itertools
import zlib

import numpy as np
import pytest

from cuesheet.llm import langid

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    make = lambda s: " ".join("".join(rng.choice(list(s), 5)) for _ in range(60))
    return langid.fit([(name, make(s)) for name, s in (("x", "abcd"), ("y", "efgh"), ("z", "ijkl")) for _ in range(20)])


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    chains = [rng.normal(size=(n, 3)) for n in (1, 6, 4)]
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    starts = np.array([0, 1, 7])
    try:
        for segment in (2, 3, 128):
            langid._SEGMENT = segment
            out = langid.marginals(model, np.concatenate(chains), starts)
            for start, chain in zip(starts, chains):
                mass = np.zeros(chain.shape)
                first = np.log(np.exp(model.transitions).sum(axis=0))
                for path in itertools.product(range(3), repeat=len(chain)):
                    total = first[path[0]] + sum(chain[t, k] for t, k in enumerate(path))
                    total += sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
                    for t, k in enumerate(path):
                        mass[t, k] += np.exp(total)
                mass /= mass.sum(axis=1, keepdims=True)
                assert np.allclose(out[start : start + len(chain)], mass, atol=1e-9)
    finally:
        langid._SEGMENT = 128


def test_switched_text_is_labelled_by_word(model):
    labeller = langid.Labeller(model)
    post = labeller.words("abcda bbcda dabca ccab " * 20 + "efgh hgfe eegf " * 30)
    best = post.argmax(axis=1)
    assert (best[:76] == 0).all() and (best[84:] == 1).all()


def test_texts_of_all_kinds(model):
    labeller = langid.Labeller(model)
    texts = [None, "", "12 -- 34", "abcd", "EFGH efgh", "ijkl " * 200_000, "é" * 50_000, "abcd" * 30_000 + " abcd"]
    names, scores = labeller.documents(texts)
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    assert names[3:6] == ["x", "y", "z"] and all(0 <= s <= 1 for s in scores)
    again = langid.Labeller(model).documents(texts[::-1])
    assert again[0][::-1] == names and np.allclose(again[1][::-1], scores, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify_documents(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)


SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


def test_filter_keeps_columns_and_rejects_no_language(spark):
    rows = [(i, "abcd dcba " * 9, "x", "s", 1) for i in range(9)] + [(i, "efgh hgf " * 9, "y", "s", 1) for i in range(20, 29)]
    rows += [(40, None, "x", "s", 1), (41, "12", None, "s", 1), (None, "abcd", None, None, None), (3, "abcd dcba " * 9, "x", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = langid.with_language(docs)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert len(ids) == 20 and 40 not in ids and 41 not in ids and None in ids and ids.count(3) == 2


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert langid.identify_documents(docs).count() == 0
    assert langid.with_language(docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, "", 0)], SCHEMA)
    assert langid.identify_documents(unlabelled).first().lang_pred == "und"


def test_a_language_of_few_texts_is_learned(spark):
    rows = [("xx", f"zig zag zog {i}") for i in range(3)] * 3000 + [("yy", f"bar ber bir {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(60)]
    model = langid.fitted(spark.createDataFrame(rows, "lang string, text string").repartition(4), 10)
    assert model.languages == ["xx", "yy"]
    assert langid.Labeller(model).documents(["zig zog", "ber bir"])[0] == ["xx", "yy"]
