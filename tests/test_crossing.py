"""Sentences that cross pages, against the cues of the joined text."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.functions.segments import cue_head, wrap_cue
from cuesheet.operators import timeline as T

SCHEMA = "doc_id long, page_number int, text string, duration double"


def cues(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r["index"], r.text, r.start_time, r.end_time))
    return {k: sorted(v) for k, v in out.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    documents = {}
    for doc, page, text, seconds in sorted(rows):
        documents.setdefault(doc, []).append((text, seconds))
    joined = spark.createDataFrame(
        [(d, " ".join(t for t, _ in p), float(sum(s for _, s in p))) for d, p in documents.items()],
        "doc_id long, text string, duration double",
    )
    want, got = cues(T.text_cues(joined, ["doc_id"])), cues(T.document_cues(df, df, "doc_id"))
    assert got.keys() == want.keys()
    for doc in want:
        assert [c[:2] for c in got[doc]] == [c[:2] for c in want[doc]], doc
        for a, b in zip(got[doc], want[doc]):
            assert a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-6)


def test_random_pages(spark):
    rng = random.Random(11)
    words = ["a", "bb", "ccc ", "dddd.", "e!", "...", "?", "x" * 59, "y" * 60, "z" * 61, "w" * 130, "  f", "g.  h", "\tq", "é", "no"]
    rows = []
    for doc in range(150):
        for page in range(rng.randrange(1, 9)):
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 5, 20, 40])))
            rows.append((doc, page * 2 + 1, text, rng.choice([0.5, 3.0, 20.0])))
    check(spark, rows)


def test_pages_without_a_sentence_end(spark):
    rows = [(1, p, f"page {p} runs", 1.5) for p in range(13_000)] + [(2, p, "b", 1.0) for p in range(200)]
    rows += [(3, p, " ", 1.0) for p in range(40)] + [(3, 50, "late start. and", 2.0), (3, 51, " ", 1.0), (3, 52, "end", 1.0)]
    check(spark, rows)


def test_heads_wrap_as_the_whole(spark):
    rng = random.Random(12)
    words = ["a", "bb", "cccc", "x" * 58, "y" * 59, "z" * 60, "w" * 61, "v" * 100, "end...", "u" * 30]
    rows = [
        (i, [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))]) for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "i int, parts array<string>")
    heads = F.array_join(F.transform("parts", cue_head), " ")
    got = df.select(wrap_cue(heads).alias("a"), wrap_cue(F.array_join("parts", " ")).alias("b"), F.length(heads).alias("n"), "parts")
    for row in got.collect():
        assert row.a == row.b, row.parts


def test_parts_of_a_sentence_are_merged(spark, monkeypatch):
    monkeypatch.setattr(T, "_PAGES", 3)
    check(spark, [(1, p, f"page {p} runs" + "." * (p % 40 == 0), 1.5) for p in range(300)])
