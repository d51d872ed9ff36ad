import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import neighbours

DATA = "/root/testdata/sf0.01/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, k=20):
    """{query: [(vec_id, score)]} by comparing all."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def ask(df):
    return neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0)


@pytest.mark.parametrize("kind", ["given", "clustered", "norms"])
def test_recall_against_all(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "LIST_VECTORS", 60)
    monkeypatch.setattr(neighbours, "_VECTORS_AT_ONCE", 50)
    monkeypatch.setattr(neighbours, "_QUERIES_AT_ONCE", 10)
    if kind == "given":
        df = spark.read.parquet(DATA).select("vec_id", "embedding")
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
    else:
        rng = np.random.default_rng(6)
        x = rng.normal(size=(1500, 24))
        x = x * rng.uniform(0.5, 4, (1500, 1)) if kind == "norms" else x * 0.2 + rng.normal(size=(20, 24))[rng.integers(20, size=1500)]
        rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = exact(rows), found(ask(df))
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.93
    vectors = dict(rows)
    for q, near in got.items():
        for i, score in near:
            assert score == pytest.approx(float(np.dot(np.float64(vectors[q]), np.float64(vectors[i]))), abs=1e-12)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (20, [0.0, -1.0], "x")]
    rows += [(4, None, "x"), (5, [0.0, 0.0], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [None, 1.0], "x")]
    rows += [(9, [1.0], "x"), (None, [1.0, 1.0], "x"), (10, [], "x"), (40, None, "x"), (2, [1.0, 0.0], "x"), (20, [0.0, -1.0], "x")]
    got = found(ask(spark.createDataFrame(rows, SCHEMA)))
    assert got == {0: [(2, 1.0), (3, 1.0), (20, 0.0)], 20: [(0, 0.0), (2, 0.0), (3, 0.0)]}


def test_same_vector_everywhere(spark):
    rows = [(i, [0.6, 0.8, 0.0], "") for i in range(1, 300)] + [(i, [0.1 * (i % 7), 1.0, 0.5], "") for i in range(300, 500)]
    got, want = found(ask(spark.createDataFrame(rows, SCHEMA))), exact([(i, np.float32(v)) for i, v, _ in rows])
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert [i for i, _ in got[20]] == [i for i, _ in want[20]]


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x"), (2, None, "")]])
def test_nothing_to_find(spark, rows):
    out = ask(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
