"""Cue times: durations, running starts and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions.arrays import array_scan
from cuesheet.functions.segments import MAX_CUE_SECONDS, MIN_CUE_SECONDS

WORDS_PER_MINUTE = 200


def _timestamp(seconds: Column, mark: str) -> Column:
    """`HH:MM:SS` and milliseconds, which are cut, not rounded, and so never carry."""

    def whole(value: Column, unit: int) -> Column:
        # Exact, where a plain quotient may round up to the next whole number.
        return ((value - value % unit) / unit).cast("int")

    def digits(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    hours = whole(seconds, 3600).cast("string")
    return F.concat(
        F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")),
        F.lit(":"),
        digits(whole(seconds % 3600, 60), 2),
        F.lit(":"),
        digits((seconds % 60).cast("int"), 2),
        F.lit(mark),
        digits(((seconds % 1) * 1000).cast("int"), 3),
    )


def srt_timestamp(seconds: Column) -> Column:
    return _timestamp(seconds, ",")


def vtt_timestamp(seconds: Column) -> Column:
    return _timestamp(seconds, ".")


def speech_rate(speed: Column) -> Column:
    """Words a minute of the offline voice at a speed factor."""
    return (speed * WORDS_PER_MINUTE).cast("int")


def speech_seconds(words: Column, speed: Column) -> Column:
    """Estimated length of spoken text; null where the rate is not positive."""
    rate = speech_rate(speed)
    return F.when(rate > 0, words * F.lit(60.0) / rate)


def cue_seconds(chars: Column, chars_per_second: Column) -> Column:
    """Time for a cue by its length, kept between the shortest and longest cue."""
    return F.greatest(
        F.lit(MIN_CUE_SECONDS), F.least(F.lit(MAX_CUE_SECONDS), chars / chars_per_second)
    )


def running_starts(seconds: Column) -> Column:
    """`struct(out, state)`: start of every cue laid end to end, and the end of the last."""
    return array_scan(seconds, F.lit(0.0), lambda at, d: at + d, lambda at, d: at, "double")
