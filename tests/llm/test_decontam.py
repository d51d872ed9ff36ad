import random
import re

import pyarrow as pa
import pytest

from cuesheet.llm import decontam

SCHEMA = "doc_id long, text string, key string, item_id int"
ITEM = "A train travels 120 km in 2 hours with Anna aboard. After 120 km the train stops and Anna walks 3 km more."
ITEMS = [
    (1, ITEM),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (3, "too short"),
    (4, None),
    (5, ""),
    (6, "1 2 3 4 5 6 7 8 9 10"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, key string")


def found(spark, benchmark, texts):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], SCHEMA)
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, benchmark).collect()}, docs


def test_passages(spark, benchmark):
    filler = " ".join(f"word{i}" for i in range(50))
    texts = [
        filler + " " + ITEM + " " + filler,
        ITEM.replace("120", "90").replace("Anna", "Boris").replace("km", "miles"),  # same question, other values
        ITEM.replace("120", "90", 1),  # all else word for word
        ITEM.upper().replace("A TRAIN", "a train"),
        "The QUICK, brown fox -- jumps over the lazy dog\nnear the river bank today!",
        "the quick brown fox jumps over nothing that anybody near a river saw",
        filler,
        None,
        "",
        "too short",
        "1 2 3 4 5 6 7 8 9 10",
        (filler + " ") * 2000 + ITEMS[1][1],
        (ITEM + "\n") * 300,
    ]
    hits, docs = found(spark, benchmark, texts)
    assert {k for k in hits if k[1] == 2} == {(4, 2), (11, 2)}
    assert {d for d, i in hits if i == 1} >= {0, 1, 2, 3, 12} and not hits[2, 1].reparameterised
    assert {k for k in hits if k[1] in (3, 6)} == {(9, 3), (10, 6)}
    assert not hits[0, 1].reparameterised and hits[1, 1].reparameterised
    assert hits[0, 1].share > 0.9 and hits[12, 1].share == 1.0 and {i for _, i in hits} == {1, 2, 3, 6}
    kept = decontam.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, i in hits if i != 3}


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    items = [" ".join(word() for _ in range(rng.randint(3, 20))) for _ in range(30)]
    docs = []
    for _ in range(200):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.5:
            item = rng.choice(items).split()
            parts.append(" ".join(item[: rng.randint(1, len(item))]))
        docs.append(" ".join(parts))
    runs = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    expected = {
        (d, i)
        for d, t in enumerate(docs)
        for i, item in enumerate(items)
        if runs(item) and sum(r in set(runs(t)) for r in runs(item)) >= 0.5 * len(runs(item))
        or not runs(item) and f" {item} " in f" {t} "
    }
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    hits, _ = found(spark, bench, docs)
    assert set(hits) == expected and len(expected) > 20


def test_template():
    text = "Mr Ärger paid 1,200.50 dollars. Then 3 KM with Émile in Rome? \"Yes\" 5 apples"
    raw, offsets = decontam.shingles.column_bytes(pa.array([text, None, "", "Ok Bob"]))
    token, value, owner = decontam.template(raw, offsets)
    kinds = {int(decontam._NUMBER): "N", int(decontam._NAME): "M", int(decontam._UNIT): "U"}
    shown = "".join(kinds.get(int(t), ".") for t in token)
    words = re.findall(r"\w[\w,.]*\w|\w", text)
    assert len(words) + 2 == len(token) and shown == ".M.NU.NU.M.M.N." + ".M"
    assert owner.tolist() == [0] * len(words) + [3, 3] and ((value != 0) == [c != "." for c in shown]).all()


def test_empty(spark, benchmark):
    docs = spark.createDataFrame([], SCHEMA)
    assert decontam.contaminated(docs, benchmark).count() == 0
    some = spark.createDataFrame([(1, ITEM, "k", 0), (None, ITEM, None, None), (1, ITEM, "k", 0)], SCHEMA)
    assert decontam.contaminated(some, benchmark.limit(0)).count() == 0
    assert decontam.without_contaminated(some, benchmark.limit(0)).count() == 3
    assert decontam.without_contaminated(some, benchmark).count() == 0


def test_capitals(spark):
    names = "Anna Maria and Boris Ivanov met Clara Stein in Rome near Villa Borghese with Emil Zola from Paris"
    plain = "the slow grey fox sleeps under the busy dog beside the lake shore today"
    bench = spark.createDataFrame([(1, plain), (2, names)], "item_id long, text string")
    hits, _ = found(spark, bench, [plain.upper(), plain.title(), names.lower(), names.upper(), "a fox sleeps"])
    assert set(hits) == {(0, 1), (1, 1), (2, 2), (3, 2)}
    assert all(r.share == 1.0 and not r.reparameterised for r in hits.values())


def test_equal_new_values(spark):
    item = "the old farmer sells 3 apples and then 5 pears to the people who pass by his small stand"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits, _ = found(spark, bench, [item.replace("3", "4").replace("5", "4"), item.replace("3", "7")])
    assert set(hits) == {(0, 1), (1, 1)}


def test_excerpts(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cuts = [words[50:77], words[50:63], words[50:62], words[:8] + ["x"] + words[20:28]]
    hits, _ = found(spark, bench, [" ".join(["before", *c, "after"]) for c in cuts])
    assert set(hits) == {(0, 1), (1, 1)}
    assert hits[0, 1].windows == 23 and hits[0, 1].share < 0.5


def test_short_and_numeric_items_against_brute_force(spark):
    rng = random.Random(6)
    units = [*"0123456789", "12", "a", "b", "本", "語", "の", "ไ"]
    spaced = lambda parts: " ".join(parts).replace("本 ", "本").replace("語 ", "語")
    items = [[rng.choice(units[: rng.choice([4, 11])] if rng.random() < 0.5 else units) for _ in range(rng.randint(1, 20))] for _ in range(40)]
    items = [i for i in items if len(i) < 5 or all(w.isdigit() for w in i)] + [["本", "語", "の"], list("31415926")]
    docs = [[rng.choice(units) for _ in range(rng.randint(0, 25))] for _ in range(150)]
    docs += [d + rng.choice(items) + d[:2] for d in docs[:60]]
    holds = lambda d, i: any(d[k : k + len(i)] == i for k in range(len(d) - len(i) + 1))
    expected = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if holds(doc, item)}
    bench = spark.createDataFrame([(i, spaced(x)) for i, x in enumerate(items)], "item_id long, text string")
    hits, _ = found(spark, bench, [spaced(d) for d in docs])
    assert set(hits) == expected and len(expected) > 60


def test_unspaced_scripts(spark):
    item = "電車は二時間で百二十キロを走りその後に駅で止まる"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits, _ = found(spark, bench, ["これは" + item + "という問題です。", "電車は駅で止まる", item.replace("百二十", "九十")])
    assert set(hits) == {(0, 1), (2, 1)}


def test_other_values_in_capitals(spark):
    item = "the old farmer sells 3 apples and then 5 pears to the people who pass by his small stand"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits, _ = found(spark, bench, [item.replace("3", "41").replace("5", "7").upper()])
    assert set(hits) == {(0, 1)} and hits[0, 1].reparameterised
