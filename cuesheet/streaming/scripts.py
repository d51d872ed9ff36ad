"""Subtitle files for scripts as they arrive.

Cleaning, timing and rendering of a script that is one row need no other row,
so the batch plan runs on a stream as it is, without any state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuesheet.plans.scripts import clean_scripts, subtitle_files, with_duration


def arriving_subtitles(scripts: DataFrame, key: str, speed: float = 1.0) -> DataFrame:
    """SRT and WebVTT files of a stream of (key, text) rows."""
    texts = clean_scripts(scripts.select(key, "text"))
    return subtitle_files(with_duration(texts, F.lit(speed)), [key])


def write_arriving(subtitles: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the files of what has arrived so far to a Parquet folder, then stop.

    `checkpoint` is a folder shared by the cluster. It keeps what was done, so
    the next run goes on with what arrived since.
    """
    return (
        subtitles.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
