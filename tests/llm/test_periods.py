"""Periodic runs against a search of all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesheet.llm import periods, queries
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string"


def all_runs(words):
    """(start, length, period) by extension of every period from every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def search(texts):
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    words = np.array([w for t in texts for w in t], dtype=np.int64)
    out = [[] for _ in texts]
    for t, start, length, period in zip(*periods.runs_of(words, offsets)):
        out[t].append((int(start), int(length), int(period)))
    return out


def words_with_repeats(rng, size, letters):
    words = [rng.randrange(letters) for _ in range(size)]
    for _ in range(rng.randrange(5)):
        p, times, at = rng.randrange(1, max(2, size // 3)), rng.randrange(2, 6), rng.randrange(size + 1)
        words[at:at] = (words[at : at + p] or [0]) * times
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = rng.randrange(letters)
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 1000])
def test_against_all_stretches(letters):
    rng = random.Random(letters)
    texts = [words_with_repeats(rng, rng.randrange(0, 90), letters) for _ in range(250)]
    for own, found in zip(texts, search(texts)):
        assert found == all_runs(own), own


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6), max_size=3))
def test_powers(parts):
    texts = [[w for word, times in text for w in word * times] for text in parts]
    assert search(texts) == [all_runs(t) for t in texts]


def test_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert search([b, [7] * 300, [], [1, 2] * 6, [1, 2] * 5 + [1]]) == [
        all_runs(b), [(0, 300, 1)], [], [(0, 12, 2)], []
    ]
    assert periods.runs_of(np.full(50_000, 3), np.array([0, 50_000]))[3].tolist() == [1]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(((-length, start, q) for start, length, q in runs), default=None)
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *row, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept))


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a b " * 6, "x" * 200_000, "é  z " * 12, "a\x0bb\x0c" * 9, "\U0001f600 \U0001f600 " * 7]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (None, "a " * 12)]
    made = periods.with_planted_runs(spark.createDataFrame(rows, SCHEMA))
    assert result(periods.run_digests(made)) == sorted((expected(*r) for r in rows), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = [expected(r.doc_id, r.text) for r in docs.where(F.length("text") < 8_000).collect()]
    got = {r[0]: r for r in map(tuple, queries.op12_periodic_runs(spark, SMALL).collect())}
    assert len(got) == docs.count() and [got[r[0]] for r in want] == want


def test_other_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 12, "x", 2)], SCHEMA + ", list string, spot int")
    (row,) = periods.periodic_runs(periods.with_planted_runs(docs), words="count").collect()
    assert (row.list, row.spot, row["count"], row.collapsed) == ("x", 2, 12, "a") and [tuple(r) for r in row.runs] == [(0, 12, 1)]
    assert periods.run_digests(spark.createDataFrame([], SCHEMA)).collect() == []
