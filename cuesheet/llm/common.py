"""Helpers that several operators share: written intermediates and running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.session import shared_folder

# Rows that one sorted block of a running total holds on average.
BLOCK_ROWS = 20_000


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back, so that
    what follows starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique_name(df: DataFrame, stem: str) -> str:
    """`stem`, lengthened until `df` has no such column (names compare without case)."""
    taken = {name.lower() for name in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def blocks_for(rows: int) -> int:
    """How many blocks of a running total `rows` rows need."""
    return max(1, -(-rows // BLOCK_ROWS))


def with_running_total(
    rows: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the same `keys` that
    stand before the row by (`block`, `order`).

    Each (keys, block) is sorted by itself and only one row per block meets
    by `keys`, so a key that holds most of the rows spreads over the cluster.
    """
    numbered = rows.withColumn("_block", block).withColumn("_value", value.cast("long"))
    by_block = [*keys, "_block"]
    totals = numbered.groupBy(*by_block).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = (
        Window.partitionBy(*by_block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = numbered.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by_block]
    return (
        summed.alias("a")
        .join(starts.alias("b"), on)
        .select("a.*", (F.col("_inside") + F.col("_start")).alias(name))
        .drop("_block", "_value", "_inside")
    )
