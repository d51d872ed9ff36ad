"""The registered queries: against their SQL, over whole tables, and the pipeline."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from cuesheet.llm import oracle, queries
from tests.conftest import SMALL

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, SMALL), duck.sql(oracle.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = ordered(tuple(r) for r in ours.select(*columns).collect())
    assert got == ordered(theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_all_are_registered():
    names = set(driver.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(oracle.oracle_sql()) <= set(driver.oracle_sql())


NATIVE = ("op2_format_conversations", "op4_mix_documents")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_stay_in_the_jvm(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEval", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert final.count() == docs.count()
    assert docs.select("doc_id").distinct().count() < before
    assert corpus_pipeline.ORACLE_SQL is None
    run = corpus_pipeline.run(spark, SMALL)
    assert run.columns == final.columns and sorted(map(repr, run.collect())) == sorted(map(repr, final.collect()))


def test_stages_take_nothing_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, key string, score int, copies int"
    for rows in ([], [(None,) * 10, (1, "", "en", None, 0, "", 1, "", 1, 1), (1, "", "en", None, 0, "", 1, "", 1, 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
            assert stage(spark, docs, SMALL).count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


def test_the_rest_works_without_these_folders(tmp_path):
    for name in ("cuesheet", "tests", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "cuesheet").unlink()
    (tmp_path / "cuesheet").mkdir()
    for part in (ROOT / "cuesheet").iterdir():
        if part.name != "llm":
            (tmp_path / "cuesheet" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(any(q.startswith('op') for q in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-E", "-c", "import sys; sys.path.insert(0, '');" + code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split()[0] == "False" and int(out.stdout.split()[1]) >= 50, out.stderr
