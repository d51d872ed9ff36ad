"""Stamps, order, roles, and how many exchanges the lookups and names take."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import names as N
from cuesheet.operators import artifacts as A
from cuesheet.operators.lookup import lookup_roles
from cuesheet.operators.order import in_order
from cuesheet.plans import catalog
from tests.conftest import SMALL


def test_stamps_do_not_depend_on_the_zone(spark):
    times = [
        datetime.datetime(2024, 3, 31, 2, 30, 0),
        datetime.datetime(1969, 12, 31, 23, 59, 59, 5),
        datetime.datetime(2024, 2, 29, 0, 0, 0, 120000),
        datetime.datetime(1, 1, 1),
    ]
    df = spark.createDataFrame([(t.isoformat(),) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(N.file_stamp(F.col("t")), N.iso_stamp(F.col("t"))).collect()
            # `%Y` of a Python date has no leading zeros everywhere.
            assert [tuple(r) for r in got] == [(t.isoformat()[:19].translate({45: None, 58: None, 84: "_"}), t.isoformat()) for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("count", [0, 1, 5, 3000])
def test_order(spark, count):
    values = [f"p{i * 7919 % 100_003}/é{i % 7}" for i in range(count)] + [None] * (count > 1)
    df = spark.createDataFrame([(v, 1) for v in values], "path string, x int").repartition(5)
    got = sorted((r.position, r.path) for r in in_order(df, "path", "position").collect())
    assert [p for p, _ in got] == list(range(1, len(values) + 1))
    assert [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v))


def test_roles_are_folded(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("a"),
        F.when(F.col("id") % 5 == 0, "hot").when(F.col("id") % 5 == 1, "k4").alias("b"),
    )
    table = spark.createDataFrame([("hot", 1), ("k4", 2), (None, 9)], "k string, v int")
    got = {r.id: (r.x, r.y) for r in lookup_roles(rows, table, "k", F.col("v"), {"x": "a", "y": "b"}, "id").collect()}
    assert got == {i: (1 if i % 3 == 0 else 2 if i == 4 else None, {0: 1, 1: 2}.get(i % 5)) for i in range(3000)}
    plan = lookup_roles(rows, table, "k", F.col("v"), {"x": "a", "y": "b"}, "id")
    assert plan.columns == ["id", "a", "b", "x", "y"]


def test_stems_share_counters(spark):
    asked = spark.createDataFrame([(1, "d/a.b", "mp3"), (2, "d/a", ".mp3"), (3, "d.x/.h", ""), (4, "d/a.c", "wav")], "id int, base string, extension string")
    taken = spark.createDataFrame([("d/a.z", "mp3", 1), ("d/a", "mp3", 1)], "base string, extension string, counter int")
    got = {r.id: r.filename for r in A.unique_names(asked, taken, F.lit("T")).collect()}
    assert got == {1: "d/a_T.mp3", 2: "d/a_T_2.mp3", 3: "d.x/.h_T", 4: "d/a_T.wav"}


@pytest.mark.parametrize("name,most", [("job_validation", 8), ("unique_names", 27), ("files_in_order", 6)])
def test_exchanges(spark, name, most):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    count = len(re.findall(r"\bExchange (?:hash|range|Single)", plan))
    assert count <= most
