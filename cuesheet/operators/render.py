"""Subtitle files as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.timecode import srt_timestamp, vtt_timestamp

VTT_HEADER = "WEBVTT\n\n"


def srt_block(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(
        index.cast("string"),
        F.lit("\n"),
        srt_timestamp(start),
        F.lit(" --> "),
        srt_timestamp(end),
        F.lit("\n"),
        text,
        F.lit("\n\n"),
    )


def vtt_block(index: Column, start: Column, end: Column, text: Column) -> Column:
    """As for SRT, but without the number."""
    return F.concat(
        vtt_timestamp(start), F.lit(" --> "), vtt_timestamp(end), F.lit("\n"), text, F.lit("\n\n")
    )


def srt_text(cues: Column) -> Column:
    """SRT file of an array of cue structs."""
    return F.array_join(F.transform(cues, lambda c: _block(srt_block, c)), "")


def vtt_text(cues: Column) -> Column:
    """WebVTT file of an array of cue structs."""
    return F.concat(F.lit(VTT_HEADER), F.array_join(F.transform(cues, lambda c: _block(vtt_block, c)), ""))


def _block(render, cue: Column) -> Column:
    return render(cue["index"], cue["start_time"], cue["end_time"], cue["text"])


def srt_blocks(cues: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of SRT files, in order of `index`, for cue rows.

    A file is its blocks one after the other; a document of any number of cues
    stays in rows until a sink writes them.
    """
    return _blocks(cues, keys, srt_block)


def vtt_blocks(cues: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of WebVTT files; the header is block 0."""
    blocks = _blocks(cues, keys, vtt_block)
    header = cues.where(F.col("index") == 1).select(
        *keys, F.lit(0).cast(cues.schema["index"].dataType).alias("index"), F.lit(VTT_HEADER).alias("block")
    )
    return blocks.unionByName(header)


def _blocks(cues: DataFrame, keys: list[str], render) -> DataFrame:
    block = render(F.col("index"), F.col("start_time"), F.col("end_time"), F.col("text"))
    return cues.select(*keys, "index", block.alias("block"))
