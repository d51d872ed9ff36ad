"""A total order over all rows, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many values split the order, at most: the size of the sample they come from.
SPLITS = 1_024


def in_order(rows: DataFrame, column: str, position: str) -> DataFrame:
    """`rows` with their place, from 1 and without gaps, in the order of a
    column of strings in which no value stands twice; nulls come first.

    The values of the smallest hashes are a random sample of bounded size that
    every reading of the rows gives alike. They cut the order into ranges, each
    sorted by itself, and the number of rows in the ranges before a range is
    added to its own ranks. Ranges hold about as many rows each whatever the
    values are, as these are all different.
    """
    value = F.col(column)
    sample = (
        rows.select(value.alias("value"), F.xxhash64(value).alias("hash"))
        .where(F.col("value").isNotNull())
        .orderBy("hash", "value")
        .limit(SPLITS)
        .agg(F.array_sort(F.collect_list("value")))
        .scalar()
    )
    splits = F.coalesce(sample, F.array().cast("array<string>"))
    # The first split that is not less, by halving the array.
    ranged = rows.withColumn("__splits", splits).withColumn(
        "__range",
        F.expr(
            f"""aggregate(sequence(1, 12), named_struct('low', 0, 'high', size(__splits)), (at, i) -> if(at.low < at.high,
                if(get(__splits, int((at.low + at.high) div 2)) < `{column}`,
                    named_struct('low', int((at.low + at.high) div 2) + 1, 'high', at.high),
                    named_struct('low', at.low, 'high', int((at.low + at.high) div 2))), at), at -> at.low)"""
        ),
    ).drop("__splits")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    # One row per range: a bounded number.
    before = counts.agg(F.map_from_entries(F.collect_list(F.struct("__range", "n")))).scalar()
    start = F.aggregate(
        F.map_entries("__counts"),
        F.lit(0).cast("bigint"),
        lambda total, range_: total + F.when(range_["key"] < F.col("__range"), range_["value"]).otherwise(0),
    )
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_first()))
    return (
        ranged.withColumn("__own", own)
        .withColumn("__counts", before)
        .withColumn(position, start + F.col("__own"))
        .drop("__range", "__own", "__counts")
    )
