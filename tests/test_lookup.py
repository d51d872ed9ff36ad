from pyspark.sql import functions as F

from cuesheet.operators.lookup import lookup


def test_hot_and_missing_keys_are_spread_and_found(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("k")
    )
    table = spark.createDataFrame([("hot", 1), ("k4", 2), ("never", 3)], "k string, v int")
    joined = lookup(rows, table, "k", "id")
    assert sorted(joined.columns) == ["id", "k", "v"]
    got = {r.id: r.v for r in joined.collect()}
    assert got == {i: 1 if i % 3 == 0 else 2 if i == 4 else None for i in range(5000)}


def test_keyless_rows_pass_the_join_by(spark):
    rows = spark.range(100).select("id", F.lit(None).cast("string").alias("k"))
    table = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert [r.v for r in lookup(rows, table, "k", "id").collect()] == [None] * 100
