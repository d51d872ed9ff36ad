"""Every query against its SQL, and the shape of the plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from cuesheet.plans import catalog, oracle
from tests.conftest import SMALL

QUERIES, ORACLES = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v if v is not None else 0) for v in row))


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert [TYPES[dict(ours.dtypes)[c]] for c in columns] == [
        str(theirs.types[theirs.columns.index(c)]) for c in columns
    ]
    got = ordered(tuple(r) for r in ours.select(*[f"`{c}`" for c in columns]).collect())
    want = ordered(theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "srt"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "InPandas", "SinglePartition"):
        # One total of all rows, the first free entry of the registry, the lengths of requests, ranges of an order.
        if operator == "SinglePartition" and name in (
            "corpus_totals", "engine_routing", "synthesis_requests", "rejected_requests", "voice_match", "files_in_order"
        ):
            continue
        assert operator not in plan


@pytest.mark.parametrize(
    "name", ["clean_text", "sentences", "cue_wrap", "caption_wrap", "cue_chunks", "tts_chunks", "text_cues", "srt_documents", "vtt_documents"]
)
def test_text_queries_shuffle_nothing(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
