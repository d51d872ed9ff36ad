"""Cue rows: (document, index, start_time, end_time, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.arrays import let
from cuesheet.functions.segments import (
    MAX_CUE_SECONDS,
    MIN_CUE_SECONDS,
    SENTENCE_END,
    cue_head,
    packed_sentences,
    sentences,
    wrap_caption,
    wrap_cue,
)
from cuesheet.functions.text import WHITESPACE_CHARS, strip
from cuesheet.functions.timecode import cue_seconds, running_starts
from cuesheet.operators.blocks import document_facts, explode_rows


def cue_array(text: Column, seconds: Column) -> Column:
    """Cues of one text as an array of structs, in order.

    Sentences share the time by length within the cue limits; then all times
    are scaled so that the last cue ends with the text. The text is one row,
    so nothing here needs a shuffle. Null where the duration is not positive.
    """

    def timed(parts: Column) -> Column:
        # Bound, so that the whole text is not measured again for every sentence.
        durations = let(
            F.length(text) / seconds,
            lambda rate: F.transform(parts, lambda s: cue_seconds(F.length(s), rate)),
        )
        return let(durations, lambda d: let(running_starts(d), lambda run: cues(parts, d, run)))

    def cues(parts: Column, durations: Column, run: Column) -> Column:
        scale = seconds / run["state"]
        return F.transform(
            F.arrays_zip(
                parts.alias("s"), durations.alias("d"), run["out"].alias("at")
            ),
            lambda c, i: F.struct(
                (i + 1).alias("index"),
                (c["at"] * scale).alias("start_time"),
                ((c["at"] + c["d"]) * scale).alias("end_time"),
                wrap_cue(c["s"]).alias("text"),
            ),
        )

    return F.when(seconds > 0, let(sentences(text), timed))


def text_cues(texts: DataFrame, keys: list[str], text: str = "text", seconds: str = "duration") -> DataFrame:
    """Cue rows of texts that are one row each."""
    cues = explode_rows(texts.select(*keys, text, seconds), cue_array(F.col(text), F.col(seconds)), "cue")
    return cues.select(*keys, "cue.*")


def duration_mismatch(pages: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Documents in which some page has no duration or some duration no page,
    with the reason. Equal counts are not enough: the numbers must match."""
    on = [key, "page_number"]
    tagged = pages.select(*on, F.lit(1).alias("p"), F.lit(0).alias("d")).unionByName(
        durations.select(*on, F.lit(0).alias("p"), F.lit(1).alias("d"))
    )
    counts = (
        tagged.groupBy(*on)
        .agg(F.sum("p").alias("p"), F.sum("d").alias("d"))
        .groupBy(key)
        .agg(
            F.sum("p").alias("total_pages"),
            F.sum("d").alias("total_durations"),
            F.count_if(F.col("p") != F.col("d")).alias("unmatched"),
        )
    )
    reason = F.when(F.col("total_pages") != F.col("total_durations"), "counts differ").otherwise(
        "page numbers differ"
    )
    return counts.where(F.col("unmatched") > 0).withColumn("reason", reason)


def page_cues(pages: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Cue rows of paged documents with a known duration for every page.

    A page's cues share its time equally and follow the pages before it; blank
    pages take their time without a cue. A cue shorter than the minimum is
    lengthened and may reach into the next. A document with a page without a
    duration, or a duration without a page, has no cues: `duration_mismatch`.
    """
    on = [key, "page_number"]
    text = strip(F.coalesce("text", F.lit("")))
    # Both forms of a page are made before the shuffle, which then carries no
    # more than the text and serves both readers of `timed`.
    forms = pages.select(
        *on,
        wrap_cue(text).alias("__whole"),
        F.transform(packed_sentences(text), wrap_cue).alias("__packed"),
    )
    known = durations.select(*on, "duration").where(F.col("duration").isNotNull())
    short = F.col("duration") <= MAX_CUE_SECONDS
    timed = forms.join(known, on, "full").withColumn(
        "__chunks",
        F.when(short & (F.size("__packed") > 0), F.array("__whole")).otherwise(F.col("__packed")),
    )
    unmatched = (F.col("__packed").isNull() | F.col("duration").isNull()).cast("bigint")
    facts = document_facts(
        timed,
        key,
        "page_number",
        {
            "time": F.coalesce("duration", F.lit(0.0)),
            "cues": F.coalesce(F.array_size("__chunks"), F.lit(0)).cast("bigint"),
            "unmatched": unmatched,
        },
    )
    complete = facts.where(F.col("unmatched_total") == 0)
    offset, duration = F.col("time_before"), F.col("duration")
    share = duration / F.array_size("__chunks")
    start = offset + F.col("__at") * share
    end = F.least(start + share, offset + duration)
    return explode_rows(
        complete.select(key, "time_before", "cues_before", "duration", "__chunks"),
        F.col("__chunks"),
        "text",
        "__at",
    ).select(
        key,
        (F.col("cues_before") + F.col("__at") + 1).alias("index"),
        start.alias("start_time"),
        F.when(end - start < MIN_CUE_SECONDS, start + MIN_CUE_SECONDS).otherwise(end).alias("end_time"),
        "text",
    )


def _told(piece: Column) -> Column:
    """What a piece of a sentence adds to it: its size, where its own text
    begins and how long that is, and the words a cue can show of it."""
    return let(
        piece,
        lambda p: F.struct(
            F.length(p).alias("size"),
            (F.length(p) - F.length(F.ltrim(p, F.lit(WHITESPACE_CHARS)))).alias("lead"),
            F.length(strip(p)).alias("solid"),
            cue_head(p).alias("head"),
        ),
    )


def document_cues(pages: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Cue rows of paged documents read as one continuous text each.

    Gives what `text_cues` gives for the assembled text and the summed
    duration, without assembling it: a page ends in the space that joins it to
    the next, so each page splits into sentences alone. Only the pieces at its
    ends may belong to a sentence that crosses pages; they carry the number of
    the sentence and meet there, as places in the text and the few words that
    a cue shows: a sentence over any number of pages is never one value.
    """
    on = [key, "page_number"]
    text = F.col("text")
    pieces = F.split(F.concat(text, F.lit(" ")), SENTENCE_END, -1)
    marks = F.regexp_extract(text, r"[.!?]*\z", 0)
    split = pages.select(
        *on,
        F.length(text).cast("bigint").alias("__length"),
        let(
            pieces,
            lambda found: F.struct(
                F.transform(found, _told).alias("pieces"),
                # Where nothing follows, the last sentence keeps its marks.
                _told(F.concat(F.get(found, F.size(found) - 2), marks)).alias("final"),
            ),
        ).alias("__told"),
    )
    paged = document_facts(
        split.join(durations.select(*on, "duration"), on, "left"),
        key,
        "page_number",
        {
            "page": F.lit(1).cast("bigint"),
            "chars": F.col("__length"),
            "breaks": (F.size("__told.pieces") - 1).cast("bigint"),
            "time": F.coalesce("duration", F.lit(0.0)),
        },
    )
    count, at = F.size("__told.pieces"), F.col("__at")
    ends = (F.col("page_before") + 1 == F.col("page_total")) & (at == count - 2)
    told = F.when(ends, F.col("__told.final")).otherwise(F.col("__piece"))
    place = F.col("chars_before") + F.col("page_before")
    # The last piece of a page ends where the page does.
    start = place + F.when((at > 0) & (at == count - 1), F.col("__length") + 1 - F.col("told.size")).otherwise(0)
    rows = explode_rows(paged.where(F.col("time_total") > 0), F.col("__told.pieces"), "__piece", "__at")
    told_rows = rows.withColumn("told", told).where(F.col("told.solid") > 0).select(
        key,
        (F.col("breaks_before") + at).alias("__no"),
        "page_number",
        (start + F.col("told.lead")).alias("__start"),
        (start + F.col("told.lead") + F.col("told.solid")).alias("__end"),
        F.col("told.head").alias("__head"),
        F.struct(
            ((F.col("chars_total") + F.col("page_total") - 1) / F.col("time_total")).alias("rate"),
            F.col("time_total").alias("seconds"),
        ).alias("__pace"),
    )
    counted = document_facts(
        _whole_sentences(told_rows, key),
        key,
        "__no",
        {
            "cue": F.lit(1).cast("bigint"),
            "time": F.col("__seconds"),
        },
    )
    scale = F.col("__pace.seconds") / F.col("time_total")
    return counted.select(
        key,
        (F.col("cue_before") + 1).alias("index"),
        (F.col("time_before") * scale).alias("start_time"),
        ((F.col("time_before") + F.col("__seconds")) * scale).alias("end_time"),
        wrap_cue(F.col("__head")).alias("text"),
    )


# Pages whose pieces of a sentence are merged at a time: 32,768, by the number's other bits.
_PAGES = 15


def _whole_sentences(pieces: DataFrame, key: str) -> DataFrame:
    """One row per sentence: (key, __no, __head, __pace, __seconds).

    A sentence of many pages is merged in two steps, whose groups are bounded
    as page numbers are; what a cue shows of a group is cut to its lines again.
    """

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(key, "__no", *by).agg(
            F.min("__start").alias("__start"),
            F.max("__end").alias("__end"),
            F.first("__pace").alias("__pace"),
            F.min("page_number").alias("page_number"),
            cue_head(F.expr("listagg(__head, ' ') within group (order by page_number)")).alias("__head"),
        )

    parts = merged(pieces.withColumn("__part", F.shiftright("page_number", _PAGES)), "__part")
    seconds = cue_seconds(F.col("__end") - F.col("__start"), F.col("__pace.rate"))
    return merged(parts).select(key, "__no", "__head", "__pace", seconds.alias("__seconds"))


def cue_stats(cues: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """Counts, lengths and durations of the cues of every document.

    The total duration is where the last cue ends. Without cues the numbers
    are zero and the shortest and longest duration are null.
    """
    seconds = F.col("end_time") - F.col("start_time")
    chars = F.length("text").cast("bigint")
    stats = cues.groupBy(key).agg(
        F.count("*").alias("total_subtitles"),
        F.max("end_time").alias("total_duration"),
        F.avg(seconds).alias("average_duration"),
        F.sum(chars).alias("total_characters"),
        F.avg(chars).alias("average_characters"),
        F.min(seconds).alias("min_duration"),
        F.max(seconds).alias("max_duration"),
    )
    zeros = {c: F.coalesce(c, F.lit(0)) for c in stats.columns[1:6]}
    return documents.select(key).join(stats, key, "left").withColumns(zeros)


def render_cues(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues as the renderer takes them, without blank ones."""
    return cues.where(strip(F.col("text")) != "").select(
        *keys, F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text"
    )


def segment_timeline(pages: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """Edit list of page videos: segments end to end, each with title and caption.

    `audio` lists (key, page_number, duration, exists) for every page that was
    spoken. A document with a page without audio or audio without a page has no
    segments; `duration_mismatch` of pages and audio reports it.
    A file that is listed but gone leaves its page out, and takes no time.
    """
    on = [key, "page_number"]
    listed = audio.select(*on, "duration", "exists").where(F.col("exists").isNotNull())
    paired = pages.select(*on, F.coalesce("text", F.lit("")).alias("text")).join(listed, on, "full")
    present = F.coalesce(F.col("exists") & F.col("text").isNotNull(), F.lit(False))
    placed = document_facts(
        paired,
        key,
        "page_number",
        {
            "time": F.when(present, F.col("duration")).otherwise(0.0),
            "segment": present.cast("bigint"),
            "unmatched": (F.col("text").isNull() | F.col("exists").isNull()).cast("bigint"),
        },
    )
    return placed.where(F.col("unmatched_total") == 0).where(present).select(
        *on,
        (F.col("segment_before") + 1).alias("segment"),
        F.col("time_before").alias("start_time"),
        (F.col("time_before") + F.col("duration")).alias("end_time"),
        F.concat(F.lit("Page "), F.col("page_number")).alias("title"),
        wrap_caption(F.col("text")).alias("caption"),
    )
