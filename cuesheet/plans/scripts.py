"""The main queries from raw scripts to subtitles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import (
    clean_text,
    processing_minutes,
    survives_cleaning,
    thousands,
    word_count,
)
from cuesheet.functions.timecode import speech_seconds
from cuesheet.operators.blocks import explode_rows
from cuesheet.operators.pages import NO_TEXT, first_page_preview, text_stats
from cuesheet.operators.render import srt_text, vtt_text
from cuesheet.operators.timeline import cue_array


def clean_scripts(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Scripts with cleaned text; those without any are dropped."""
    return scripts.where(survives_cleaning(F.col(text))).withColumn(text, clean_text(F.col(text)))


def with_duration(texts: DataFrame, speed: Column, measured: str | None = None) -> DataFrame:
    """Add `duration` in seconds: the measured one if there is one, else an estimate."""
    estimate = speech_seconds(word_count(F.col("text")), speed)
    return texts.withColumn("duration", F.coalesce(measured, estimate) if measured else estimate)


def subtitle_files(texts: DataFrame, keys: list[str]) -> DataFrame:
    """SRT and WebVTT file of every text with a duration, within its row.

    Texts without one have no cues and are dropped after the fact: Spark would
    push a filter on the duration below everything the duration is made of,
    and work that out twice.
    """
    cues = F.array(cue_array(F.col("text"), F.col("duration")))
    timed = explode_rows(texts.select(*keys, "text", "duration"), cues, "cues")
    return timed.select(*keys, srt_text(F.col("cues")).alias("srt"), vtt_text(F.col("cues")).alias("vtt"))


def text_report(pages: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """The preview of every document: counts, first page, processing time."""
    stats = text_stats(pages, key, documents)
    first = first_page_preview(pages, key)
    return stats.join(first, key, "left").select(
        key,
        "total_pages",
        thousands(F.col("total_characters")).alias("characters"),
        thousands(F.col("total_words")).alias("words"),
        "average_words_per_page",
        F.coalesce("preview", F.lit(NO_TEXT)).alias("preview"),
        processing_minutes(F.col("total_characters")).alias("minutes"),
    )
