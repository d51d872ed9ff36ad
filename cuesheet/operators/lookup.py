"""Looking up facts under keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Inner join of `rows` with `table`, which has few rows per `key`.

    The rows of a key are spread as by `lookup`, so that a key with most of
    the rows makes no task large.
    """
    shared = _shared(rows, row_id)
    pairs = shared.select(key, "__share").distinct()
    return shared.join(pairs.join(table, key), [key, "__share"]).drop("__share")


def _shared(rows: DataFrame, row_id: str) -> DataFrame:
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("__share", F.pmod(F.xxhash64(row_id), F.lit(shares)).cast("int"))


def lookup(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join of `rows` with `table`, which has at most one row per `key`.

    Rows with the same key are spread over as many shares as a shuffle has
    partitions, by `row_id`. The table is joined to the distinct (key, share)
    pairs: a key that is everywhere makes one of each, a rare one no more than
    it has rows. Rows without a key have nothing to find and pass by the join.
    """
    keyed = _shared(rows.where(F.col(key).isNotNull()), row_id)
    pairs = keyed.select(key, "__share").distinct()
    found = keyed.join(pairs.join(table, key), [key, "__share"], "left").drop("__share")
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def lookup_roles(
    rows: DataFrame, table: DataFrame, key: str, value: Column, roles: dict[str, str], row_id: str
) -> DataFrame:
    """`rows` with what `table`, which has each `key` once, says under the keys
    in several columns: for every entry of `roles`, name of the new column to
    name of the column that holds its key, `value`; null for none.

    Every row is sent once per role to its key, spread as by `lookup`, and
    folded together by `row_id`, which tells the rows apart. So a table is read
    and joined once, however many roles there are.
    """
    asked = F.array(
        *[F.struct(F.lit(i).alias("role"), F.col(column).alias("key")) for i, column in enumerate(roles.values())]
    )
    packed = rows.select(F.col(row_id).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), asked.alias("__asked"))
    sent = _shared(packed.select("__id", "__row", F.explode("__asked").alias("__asked")), "__id").select(
        "__id",
        F.when(F.col("__asked.role") == 0, F.col("__row")).alias("__row"),  # travels once
        F.col("__asked.role").alias("__role"),
        F.col("__asked.key").alias("__key"),
        "__share",
    )
    pairs = sent.where(F.col("__key").isNotNull()).select("__key", "__share").distinct()
    known = pairs.join(table.select(F.col(key).alias("__key"), value.alias("__value")), "__key")
    found = sent.join(known, ["__key", "__share"], "left")
    folded = found.groupBy("__id").agg(
        F.max("__row").alias("__row"),
        *[F.max(F.when(F.col("__role") == i, F.col("__value"))).alias(name) for i, name in enumerate(roles)],
    )
    return folded.select("__row.*", *roles)
