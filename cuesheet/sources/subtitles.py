"""Subtitle files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_subtitles(blocks: DataFrame, folder: str, key: str) -> None:
    """One subtitle file per document, in a folder of its own.

    `blocks` holds (key, index, block). A document's blocks are brought to one
    task, sorted there (on disk if need be) and written one after the other;
    nothing is gathered in memory, whatever the number of cues.
    """
    # The writer ends every value with a line feed of its own.
    value = F.regexp_replace("block", r"\n\z", "").alias("value")
    ordered = blocks.repartition(key).sortWithinPartitions(key, "index")
    ordered.select(key, value).write.mode("overwrite").partitionBy(key).text(folder)


def write_subtitle_table(files: DataFrame, folder: str, key: str, buckets: int) -> None:
    """Subtitle files as rows of a table in `buckets` folders, by hash of the
    key: for corpora of more documents than a file system wants folders."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = files.withColumn("bucket", bucket).repartition(buckets, "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def file_blocks(files: DataFrame, key: str, column: str) -> DataFrame:
    """Blocks of files that are one string each, as `write_subtitles` takes them."""
    return files.select(key, F.lit(0).alias("index"), F.col(column).alias("block"))
