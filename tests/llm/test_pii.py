"""Personal data: base spans against plain patterns, votes against planted reliabilities."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from cuesheet.llm import pii, queries
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return max(map(int, span.split("."))) <= 255
    if kind == "card":
        doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [
        (m.start(), k, m.end())
        for k, kind in enumerate(PLAIN)
        for m in re.finditer(PLAIN[kind], text or "")
        if checked(kind, m.group())
    ]
    return [(list(PLAIN)[k], start, end) for start, k, end in sorted(found)]


def row_of(doc_id, text):
    spans = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    counts = [sum(k == kind for k, _, _ in spans) for kind in PLAIN]
    return (doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest())


def numbers(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
    return [
        card, card[:-1] + str((int(card[-1]) + 1) % 10), f"{card[:4]} {card[4:8]}-{card[8:12]} {card[12:]}",
        f"+1 ({card[:3]}) 555-{card[3:7]}", f"({card[:3]}) 555-{card[3:7]}", "+" + card, f"{card[:2]}.1.2.3", "1.2.3.4.5.6.7.8.9",
        "256.1.1.1", "0001.2.3.00255", "a.b@c.de_f@g.hi", "x@@y.z", "@a.b", "u@-.-", "me@host", "q@a.b.", "12 " + card, "+1..", "+(1) 2",
        "é" + card, "john [at] mail [dot] com", card + " 7", "1-" * 9 + "1",
    ]


def texts(seed, count):
    rng = random.Random(seed)
    plain = ["und", "the", "é", "\U0001f600", "\n", ",", "call", "key =", "x" * 30, ".", "-", " ", "+", "@", "7"]
    return ["".join(rng.choice(["", " ", " ", "\n"]) + rng.choice(plain + numbers(rng)) for _ in range(rng.randrange(12))) for _ in range(count)]


def test_base_spans_equal_plain_patterns():
    for text in texts(1, 4_000):
        found = sorted((s.start, s.kind, s.end) for s in pii.spans_of(text) if s.base)
        assert [(pii.KINDS[k], a, b) for a, k, b in found] == base(text), text


def test_documents(spark):
    rows = [*enumerate(texts(2, 300)), (7, None), (7, ""), (None, "a@b.cd"), (None, "a@b.cd"), (9, "x " * 100_000 + "+1 (234) 555-6789")]
    df = spark.createDataFrame([(*r, "f") for r in rows], SCHEMA + ", found string")
    got = sorted((tuple(r) for r in pii.span_digests(df).collect()), key=repr)
    assert sorted((r[:6] for r in got), key=repr) == sorted((row_of(*r) for r in rows), key=repr)
    want = {(row_of(*r)[0], row_of(*r)[5]): base(r[1]) for r in rows}
    for r in got:
        spans = [s.split(":") for s in r[6].split(",") if s]
        for kind, start, end in want[r[0], r[5]]:
            assert [kind, str(start), str(end)] in spans
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
    assert pii.personal_data(df).columns == ["doc_id", "found", "spans"]
    assert pii.span_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_added_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        digits = "".join(rng.choice("0123456789") for _ in range(14))
        card = next("4" + digits + c for c in "0123456789" if pii.luhn("4" + digits + c))
        rows += [(i, f"pay with card {card} now"), (i, f"mail me at u{i}@host.com today"), (i, f"call +1 ({card[1:4]}) 555-{card[4:8]} please")]
        rows.append((i, f'token = "{card[:13]}ab{card}" and order 1{digits[:11]} of things'))
    wrong = next(f"12 {r[1].split()[3]}" for r in rows if "card" in r[1] and not checked("card", "12" + r[1].split()[3]))
    rows += [(1000, f"item {wrong} paid by card"), (1001, "please call (212) 555-0123 today"), (1002, "mail jane.doe [at] host [dot] com now")]
    rows += [(1003, "nothing here at all. The 12 of 1999 - 2004, v1.2.3"), (1004, "dear Dr. Maria Keller, regards")]
    spans = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    at = rows[-5][1].index(wrong) + 3
    assert spans[1000] == [("card", at, at + 16, False)]
    assert spans[1001] == [("phone", 12, 26, False)]
    assert spans[1002] == [("email", 5, 5 + len("jane.doe [at] host [dot] com"), False)]
    assert spans[1003] == []
    assert all(s[3] for s in spans[399])  # the last row of this id holds a token and an order number


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(5)
    real = rng.random(60_000) < 0.4
    right = [0.95, 0.9, 0.75, 0.6, 0.85]
    said = np.zeros((len(real), 5), dtype=np.int64)
    for j, chance in enumerate(right):
        truth = np.where(rng.random(len(real)) < chance, real, ~real)
        said[:, j] = np.where(rng.random(len(real)) < 0.8, np.where(truth, pii.YES, pii.NO), pii.NOTHING)
    patterns, count = np.unique(said, axis=0, return_counts=True)
    kind = np.zeros(len(patterns), dtype=np.int64)
    model = pii.estimate(kind, patterns, count.astype(float))
    assert np.allclose(model.yes, right, atol=0.03) and np.allclose(model.no, right, atol=0.03)
    assert abs(model.prior[0] - 0.4) < 0.02
    chance = model.probability(np.zeros(len(said), dtype=np.int64), said)
    assert ((chance > 0.5) == real).mean() > 0.95


def test_classifier_follows_its_targets():
    rows = [[1, 5], [1, 6], [2, 5], [2, 6]] * 50
    target = np.array([1.0, 1.0, 0.0, 0.0] * 50)
    weights = pii.train(rows, target, np.ones(len(rows)))
    assert ((pii._scores(weights, rows) > 0.5) == (target > 0.5)).all()


@pytest.mark.parametrize("unit", ["1", "1 ", "1.", "a", "a@", "+1", "+", "(", "a [at] ", "1-", "@", "1@", "Dr. ", "Dr. A"])
def test_long_texts_take_linear_time(unit):
    start = time.monotonic()
    pii.spans_of(unit * 200_000)
    assert time.monotonic() - start < 8


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r)[:6] for r in queries.op13_personal_data(spark, SMALL).collect())
    assert got == sorted(row_of(r.doc_id, r.text) for r in docs)
