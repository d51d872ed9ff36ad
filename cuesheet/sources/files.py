"""Script files and their metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions.names import base_name, suffix

_BYTES_PER_MB = 1048576
_FILES = "path string, modified timestamp, size bigint"


def find_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Files below a folder in order of their paths; none if it is missing.

    Contents are never read: only the listing columns of the scan are used.
    Spark's scan leaves out files of no bytes; these hold no script.
    """
    try:
        scan = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(folder)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES)
    return scan.select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    ).orderBy("path")


def file_info(files: DataFrame) -> DataFrame:
    """Size, suffix and name; megabytes are rounded half to even."""
    return files.withColumns(
        {
            "size_mb": F.bround(F.col("size") / F.lit(float(_BYTES_PER_MB)), 2),
            "suffix": suffix(F.col("path")),
            "name": base_name(F.col("path")),
        }
    )


def lookup_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Information about requested paths; `exists` is false for the missing."""
    known = file_info(files).withColumn("__found", F.lit(True))
    found = paths.join(known, "path", "left")
    return found.withColumn("exists", F.coalesce("__found", F.lit(False))).drop("__found")
