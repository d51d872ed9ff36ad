"""File names and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; empty for none, for a leading dot only and for a trailing dot."""
    return F.regexp_extract(base_name(path), r"(?s)^.+?(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def without_suffix(path: Column) -> Column:
    """The path with the stem of its last part in the place of that."""
    return F.regexp_replace(path, r"(?s)(?<=[^/])\.[^./]+\z", "")


def page_file(prefix: Column, number: Column, extension: Column) -> Column:
    """`prefix_007.ext`"""
    return F.concat(prefix, F.lit("_"), F.format_string("%03d", number), extension)


def complete_file(prefix: Column, extension: Column) -> Column:
    return F.concat(prefix, F.lit("_complete"), extension)


def dotted(extension: Column) -> Column:
    """The extension with a leading dot; an empty one stays empty."""
    bare = (extension == "") | extension.startswith(".")
    return F.when(bare, extension).otherwise(F.concat(F.lit("."), extension))


def timestamped(base: Column, stamp: Column, counter: Column, extension: Column) -> Column:
    """`base_stamp.ext`, with `_counter` where the counter is not zero."""
    tail = F.when(counter == 0, F.lit("")).otherwise(F.concat(F.lit("_"), counter.cast("string")))
    return F.concat(base, F.lit("_"), stamp, tail, dotted(extension))


def file_stamp(time: Column) -> Column:
    """`20240131_235959` of a local time without a zone (timestamp_ntz).

    Its text is taken, which depends on no zone of a session."""
    return F.translate(F.substring(time.cast("string"), 1, 19), " -:", "_")


def iso_stamp(time: Column) -> Column:
    """`2024-01-31T23:59:59` of a local time without a zone, with six digits of
    the second's fraction where it has one."""
    text = F.translate(time.cast("string"), " ", "T")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
