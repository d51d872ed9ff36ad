"""Packing by composed maps against a plain loop, and combined requests against the joined text."""

import random

import pytest

from cuesheet.functions.packing import compose, pack_from, pack_map, packed_chunks
from cuesheet.operators.jobs import packed_documents


def loop(lengths, level, limit, gap):
    opened = 0
    for n in lengths:
        if level + n > limit:
            opened, level = opened + 1, 0
        level += n + gap
    return opened, level


@pytest.mark.parametrize("limit,most", [(7, 3), (20, 9), (50, 80), (5000, 900)])
def test_maps_equal_a_loop(spark, limit, most):
    rng = random.Random(limit)
    cases = []
    for i in range(60):
        parts = [[rng.randrange(0, most) for _ in range(rng.randrange(0, 12))] for _ in range(rng.randrange(0, 6))]
        cases.append((i, parts, rng.choice([0, limit // 2, limit, limit + 1, rng.randrange(limit + 2)])))
    df = spark.createDataFrame(cases, "i int, parts array<array<long>>, level long")
    rows = df.selectExpr("*", f"transform(parts, p -> {pack_map('p', limit, 2)}) as maps").selectExpr(
        "i",
        f"{pack_from(compose('maps', limit), '0L', 'level', limit)} as a",
        f"{pack_from(pack_map('flatten(parts)', limit, 2), '0L', 'level', limit)} as b",
        f"{packed_chunks('maps', limit)} as n",
    )
    for row in rows.collect():
        lengths = [n for part in cases[row.i][1] for n in part]
        want = loop(lengths, cases[row.i][2], limit, 2)
        # Levels above the limit act alike and may be given as the least of them.
        assert all((r.opened, min(r.level, limit + 1)) == (want[0], min(want[1], limit + 1)) for r in (row.a, row.b))
        assert row.n == loop(lengths, limit + 1, limit, 2)[0]


def chunks(text, limit):
    """The calls of a whole text."""
    if len(text) <= limit:
        return 1
    out, current = 0, ""
    for sentence in text.split(". "):
        if len(current + sentence) <= limit:
            current += sentence + ". "
        else:
            out += bool(current)
            current = sentence + ". "
    return out + bool(current)


def test_documents_equal_the_joined_text(spark):
    rng = random.Random(8)
    words = ["a", "bb.", "ccc", "dd. ee.", ".", "x" * 40, "end.", "..", "é. "]
    rows = []
    for doc in range(40):
        for page in range(rng.randrange(1, 30)):
            rows.append((doc, page * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) if rng.random() < 0.95 else None))
    rows += [(100, p, "no sentence ends here") for p in range(10_000)]
    rows += [(101, p, "Short ones. They end here. Go") for p in range(10_000)]
    rows += [(200, 1, " "), (200, 2, ""), (201, 1, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(4)
    keys = spark.createDataFrame([(d,) for d in [*range(0, 40, 2), 100, 101, 200, 201, 999, 100]], "doc_id long")
    for limit in (60, 5000):
        texts = {}
        for doc, _, text in rows:
            texts.setdefault(doc, []).append(text)
        want = {}
        for doc in [*range(0, 40, 2), 100, 101]:
            text = " ".join(t for t in texts[doc] if t is not None)
            if text.strip():
                want[doc] = (len(text), chunks(text, limit))
        got = {r.doc_id: (r.n_chars, r.n_chunks) for r in packed_documents(pages, keys, "doc_id", limit).collect()}
        assert got == want


def test_no_exchange_carries_texts(spark):
    pages = spark.createDataFrame([(1, 1, "a. b")], "doc_id long, page_number int, text string")
    plan = packed_documents(pages, pages.select("doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "listagg" not in plan
    tops = [line for line in plan.splitlines() if "Exchange" in line]
    assert tops and not any("text" in line for line in tops)
