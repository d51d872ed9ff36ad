"""Every operator as a query over the given tables.

The adapters at the top give the tables the shape of the data model. What has
no table of its own (which extraction failed, which audio is missing, what a
job asks for) follows from a property of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions.names import file_stamp, iso_stamp, page_file
from cuesheet.functions.segments import cue_chunks, paragraphs, request_chunks, sentences, wrap_caption, wrap_cue
from cuesheet.functions.text import clean_text, word_count
from cuesheet.functions.timecode import speech_rate, speech_seconds, srt_timestamp, vtt_timestamp
from cuesheet.operators import artifacts as A
from cuesheet.operators import jobs as J
from cuesheet.operators import pages as P
from cuesheet.operators import render as R
from cuesheet.operators import timeline as T
from cuesheet.operators.blocks import explode_rows
from cuesheet.operators.order import in_order
from cuesheet.plans import scripts as S
from cuesheet.session import shared_folder
from cuesheet.sources.files import file_info, lookup_files
from cuesheet.sources.manifests import read_manifest_documents, read_manifests, write_manifest_documents, write_manifests
from cuesheet.sources.sink import read_documents, write_documents
from cuesheet.sources.subtitles import file_blocks
from cuesheet.sources.tables import html_paragraphs, html_title, read_table

Query = Callable[[SparkSession, str], DataFrame]

KEY = "doc_id"
CREATED = "2024-01-01T00:00:00"
SLOW_PAGE_WORDS = 150
SHORT_PAGE_WORDS = 8
SECOND_JOB = 1_000_000_000

_queries: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _queries[name] = fn
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


# Adapters ------------------------------------------------------------------


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", *columns)


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous scripts, cleaned, with their estimated duration."""
    return S.with_duration(S.clean_scripts(documents(spark, folder, "text")), F.lit(1.0))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as raw paged documents: a turn is a page."""
    return read_table(spark, folder, "conversations", "text").select(
        F.col("conv_id").alias(KEY), (F.col("turn") + 1).cast("int").alias("page_number"), "text"
    )


def paged(spark: SparkSession, folder: str) -> DataFrame:
    return P.page_rows(turns(spark, folder), "text", P.PRIMARY_METHOD)


def paged_documents(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select(KEY).distinct()


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of every page."""
    seconds = speech_seconds(word_count(F.col("text")), F.lit(1.0))
    return paged(spark, folder).select(KEY, "page_number", seconds.alias("duration"))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Synthesis results: very short pages give no audio."""
    ok = word_count(F.col("text")) >= SHORT_PAGE_WORDS
    return paged(spark, folder).select(
        KEY,
        "page_number",
        page_file(F.concat(F.lit("c"), F.col(KEY)), F.col("page_number"), F.lit(".mp3")).alias("path"),
        ok.alias("ok"),
    )


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages", "url", "html").withColumnRenamed("page_id", KEY)


def job_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Job settings; some are left to the defaults, and a third of the
    documents have a second job with other settings."""
    step = F.explode(
        F.when(F.col(KEY) % 3 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    )
    n = F.col(KEY) + F.col("step")

    def pick(by: int, *values: str | None):
        choice = F.array(*[F.lit(v) for v in values])
        return F.element_at(choice, (n % by).cast("int") + 1)

    speed = F.lit(0.3) + (n % 20) / F.lit(10.0)
    return documents(spark, folder, "lang", "source").select("*", step.alias("step")).select(
        (F.col(KEY) + F.col("step") * SECOND_JOB).alias("job_id"),
        KEY,
        F.when(n % 5 != 0, speed).alias("speed"),
        (n % 121 - 60).cast("int").alias("pitch"),
        pick(4, "1920x1080", "1280x720", "0x480", "wide").alias("resolution"),
        F.col("lang").alias("language"),
        pick(4, *J.ENGINES, "other").alias("engine"),
        pick(3, "audio", "video", "both").alias("output_type"),
        pick(5, None, "mp3", "wav", "ogg", "mp3").alias("audio_format"),
        (n % 2 == 0).alias("subtitles"),
        (n % 3 == 0).alias("separate_pages"),
        F.when(n % 3 == 0, F.upper("lang"))
        .when(n % 3 == 1, F.concat("lang", F.lit("/"), "source"))
        .alias("voice_id"),
        F.lit("ignored").alias("unknown_setting"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return J.with_defaults(job_overrides(spark, folder), ["job_id", KEY])


def script_path() -> Column:
    """The file of a document's script."""
    suffixes = F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".txt"))
    suffix = F.element_at(suffixes, (F.col(KEY) % 3).cast("int") + 1)
    return F.concat(F.lit("d"), F.col(KEY), suffix)


def script_paths(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, "n_chars").select(KEY, "n_chars", script_path().alias("path"))


def engines(spark: SparkSession) -> DataFrame:
    rows = [(name, i, name == "gtts") for i, name in enumerate(J.ENGINES)]
    return spark.createDataFrame(rows, "name string, ordinal int, available boolean")


def routed(spark: SparkSession, folder: str) -> DataFrame:
    return J.route_engines(jobs(spark, folder), engines(spark))


# Text and pages ------------------------------------------------------------


@_query("clean_scripts")
def clean_scripts(spark, folder):
    return S.clean_scripts(documents(spark, folder, "text"))


@_query("clean_text")
def clean_text_all(spark, folder):
    return documents(spark, folder, "text").select(KEY, clean_text(F.col("text")).alias("text"))


@_query("page_rows")
def page_rows(spark, folder):
    return paged(spark, folder)


@_query("html_page_rows")
def html_page_rows(spark, folder):
    pages = web_pages(spark, folder)
    return P.pages_of_elements(pages, html_paragraphs(F.col("html")), P.PRIMARY_METHOD).select(
        KEY, "page_number", "text", "extraction_method"
    )


@_query("extract_fallback")
def extract_fallback(spark, folder):
    """The first extractor fails on pages that are not served securely."""
    pages = web_pages(spark, folder)
    wanted = [KEY, "page_number", "text", "extraction_method"]
    primary = P.pages_of_elements(
        pages.where(F.col("url").startswith("https:")), html_paragraphs(F.col("html")), P.PRIMARY_METHOD
    ).select(wanted)
    secondary = P.pages_of_elements(
        pages, F.array(html_title(F.col("html"))), P.SECONDARY_METHOD
    ).select(wanted)
    return P.extract_fallback(primary, secondary, KEY)


@_query("text_stats")
def text_stats(spark, folder):
    return P.text_stats(paged(spark, folder), KEY, paged_documents(spark, folder))


@_query("corpus_totals")
def corpus_totals(spark, folder):
    return P.corpus_totals(paged(spark, folder))


@_query("doc_assembly")
def doc_assembly(spark, folder):
    return P.assemble(paged(spark, folder), KEY)


@_query("doc_preview")
def doc_preview(spark, folder):
    return P.document_preview(paged(spark, folder), KEY, paged_documents(spark, folder))


@_query("first_page_preview")
def first_page_preview(spark, folder):
    return P.first_page_preview(paged(spark, folder), KEY)


@_query("text_report")
def text_report(spark, folder):
    return S.text_report(paged(spark, folder), KEY, paged_documents(spark, folder))


@_query("empty_documents")
def empty_documents(spark, folder):
    """Web pages whose secure form gives no page."""
    pages = web_pages(spark, folder)
    found = P.pages_of_elements(
        pages.where(F.col("url").startswith("https:")), html_paragraphs(F.col("html")), P.PRIMARY_METHOD
    )
    return P.empty_documents(pages.select(KEY), found, KEY)


# Segmentation --------------------------------------------------------------


def _numbered(rows: DataFrame, array, value: str) -> DataFrame:
    exploded = explode_rows(rows, array, value, "__at")
    return exploded.select(KEY, (F.col("__at") + 1).alias("index"), value)


@_query("sentences")
def sentence_rows(spark, folder):
    return _numbered(S.clean_scripts(documents(spark, folder, "text")), sentences(F.col("text")), "sentence")


@_query("cue_wrap")
def cue_wrap(spark, folder):
    """Every sentence of every script as cue text."""
    parts = sentences(F.col("text"))
    return _numbered(S.clean_scripts(documents(spark, folder, "text")), F.transform(parts, wrap_cue), "cue")


@_query("caption_wrap")
def caption_wrap(spark, folder):
    return S.clean_scripts(documents(spark, folder, "text")).select(
        KEY, wrap_caption(F.col("text")).alias("caption")
    )


@_query("cue_chunks")
def cue_chunk_rows(spark, folder):
    wrapped = F.transform(cue_chunks(F.col("text"), F.col("duration")), wrap_cue)
    return _numbered(scripts(spark, folder), wrapped, "chunk")


@_query("tts_chunks")
def tts_chunks(spark, folder):
    texts = S.clean_scripts(documents(spark, folder, "text"))
    return _numbered(texts, request_chunks(F.col("text")), "chunk")


@_query("paragraphs")
def paragraph_rows(spark, folder):
    return _numbered(documents(spark, folder, "text"), paragraphs(F.col("text")), "paragraph")


# Timelines -----------------------------------------------------------------


@_query("speech_duration")
def speech_duration(spark, folder):
    """Estimated seconds at each job's speed; a job at full speed was measured."""
    speed = F.lit(0.3) + (F.col(KEY) % 20) / F.lit(10.0)
    texts = S.clean_scripts(documents(spark, folder, "text", "n_chars")).withColumn(
        "measured", F.when(speed > 2.0, F.col("n_chars") / F.lit(15.0))
    )
    return S.with_duration(texts, speed, "measured").select(
        KEY, speech_rate(speed).alias("rate"), "duration"
    )


@_query("text_cues")
def text_cues(spark, folder):
    return T.text_cues(scripts(spark, folder), [KEY])


@_query("page_cues")
def page_cues(spark, folder):
    return T.page_cues(paged(spark, folder), durations(spark, folder), KEY)


def _measured(spark, folder) -> DataFrame:
    """Durations without those of pages too long to be measured; in some
    documents they are counted from 2."""
    words = word_count(F.col("text"))
    seconds = speech_seconds(words, F.lit(1.0))
    number = F.col("page_number") + F.when(F.col(KEY) % 3 == 1, 1).otherwise(0)
    return (
        paged(spark, folder)
        .where(words <= SLOW_PAGE_WORDS)
        .select(KEY, number.alias("page_number"), seconds.alias("duration"))
    )


@_query("duration_mismatch")
def duration_mismatch(spark, folder):
    return T.duration_mismatch(paged(spark, folder), _measured(spark, folder), KEY)


@_query("measured_page_cues")
def measured_page_cues(spark, folder):
    """As `page_cues`, where some documents lack a duration and are left out."""
    return T.page_cues(paged(spark, folder), _measured(spark, folder), KEY)


@_query("document_cues")
def document_cues(spark, folder):
    return T.document_cues(paged(spark, folder), durations(spark, folder), KEY)


@_query("cue_stats")
def cue_stats(spark, folder):
    """Averages are rounded: their last digits depend on the order of adding."""
    cues = T.text_cues(scripts(spark, folder), [KEY])
    averages = ("average_duration", "average_characters")
    return T.cue_stats(cues, KEY, documents(spark, folder)).withColumns(
        {name: F.round(name, 6) for name in averages}
    )


@_query("render_cues")
def render_cues(spark, folder):
    return T.render_cues(T.text_cues(scripts(spark, folder), [KEY]), [KEY])


def _spoken(spark, folder) -> DataFrame:
    """Audio of all pages; the files of very short ones are gone, and in some
    documents the pages were counted from 2."""
    words = word_count(F.col("text"))
    number = F.col("page_number") + F.when(F.col(KEY) % 3 == 1, 1).otherwise(0)
    return paged(spark, folder).select(
        KEY,
        number.alias("page_number"),
        speech_seconds(words, F.lit(1.0)).alias("duration"),
        (words >= SHORT_PAGE_WORDS).alias("exists"),
    )


@_query("segment_timeline")
def segment_timeline(spark, folder):
    return T.segment_timeline(paged(spark, folder), _spoken(spark, folder), KEY)


@_query("segment_mismatch")
def segment_mismatch(spark, folder):
    return T.duration_mismatch(paged(spark, folder), _spoken(spark, folder), KEY)


# Subtitle files ------------------------------------------------------------


def _clock(spark, folder) -> DataFrame:
    return documents(spark, folder, "n_chars").withColumn("seconds", F.col("n_chars") / F.lit(7.0))


@_query("srt_timestamp")
def srt_time(spark, folder):
    return _clock(spark, folder).select(KEY, srt_timestamp(F.col("seconds")).alias("timestamp"))


@_query("vtt_timestamp")
def vtt_time(spark, folder):
    return _clock(spark, folder).select(KEY, vtt_timestamp(F.col("seconds")).alias("timestamp"))


@_query("srt_documents")
def srt_documents(spark, folder):
    return S.subtitle_files(scripts(spark, folder), [KEY]).select(KEY, "srt")


@_query("vtt_documents")
def vtt_documents(spark, folder):
    return S.subtitle_files(scripts(spark, folder), [KEY]).select(KEY, "vtt")


@_query("srt_files")
def srt_files(spark, folder):
    """The subtitle files of `srt_documents`, written one by one and read again."""
    target = f"{shared_folder(spark).rstrip('/')}/srt-files-{uuid.uuid4().hex}"
    made = S.subtitle_files(scripts(spark, folder), [KEY])
    write_documents(file_blocks(made, KEY, "srt"), target, KEY, ".srt", whole=True)
    files = read_documents(spark, target, ".srt")
    return files.select(F.col("key").cast("bigint").alias(KEY), F.col("value").alias("srt"))


@_query("page_srt")
def page_srt(spark, folder):
    """A subtitle file for every page that has audio."""
    pages = A.page_subtitle_names(paged(spark, folder), KEY, F.concat(F.lit("c"), F.col(KEY)))
    made = outcomes(spark, folder).where("ok").select(KEY, "page_number")
    timed = S.with_duration(pages.join(made, [KEY, "page_number"]), F.lit(1.0))
    keys = [KEY, "page_number", "filename"]
    return S.subtitle_files(timed, keys).select(*keys, "srt")


@_query("page_cue_srt")
def page_cue_srt(spark, folder):
    return R.srt_blocks(page_cues(spark, folder), [KEY])


@_query("page_cue_vtt")
def page_cue_vtt(spark, folder):
    return R.vtt_blocks(page_cues(spark, folder), [KEY])


# Jobs ----------------------------------------------------------------------


@_query("job_defaults")
def job_defaults(spark, folder):
    return jobs(spark, folder)


@_query("config_snapshot")
def config_snapshot(spark, folder):
    return jobs(spark, folder).select("job_id", J.config_snapshot().alias("config"))


@_query("format_gate")
def format_gate(spark, folder):
    return J.format_gate(script_paths(spark, folder).select(KEY, "path"))


@_query("job_validation")
def job_validation(spark, folder):
    """Scripts of a few characters have no file; only one background has."""
    paths = script_paths(spark, folder)
    background = F.when(F.col(KEY) % 7 == 0, "plain.png").when(F.col(KEY) % 11 == 0, "lost.png")
    wanted = jobs(spark, folder).withColumns({"input_path": script_path(), "background": background})
    backgrounds = spark.createDataFrame([("plain.png",)], "path string")
    existing = paths.where("n_chars >= 100").select("path").unionByName(backgrounds)
    checked = J.validate(wanted, existing)
    size = J.resolution(F.col("resolution"))
    return checked.select(
        "job_id", size["width"].alias("width"), size["height"].alias("height"), "reject_reason"
    )


@_query("engine_routing")
def engine_routing(spark, folder):
    return routed(spark, folder).select("job_id", "engine", "routed_engine", "routing")


@_query("voice_match")
def voice_match(spark, folder):
    voices = documents(spark, folder, "lang", "source").groupBy("lang", "source").agg(
        F.min(KEY).alias("ordinal")
    )
    engine = F.when(F.col("ordinal") % 2 == 0, "pyttsx3").otherwise("gtts")
    voices = voices.select(
        F.concat(F.lit("Voice-"), "lang", F.lit("/"), F.initcap("source")).alias("id"),
        engine.alias("engine"),
        "ordinal",
    )
    return J.match_voices(jobs(spark, folder), voices).select("job_id", "voice_id", "matched_voice")


@_query("synthesis_requests")
def synthesis_requests(spark, folder):
    """Paged documents by page or as a whole, as their job says; continuous
    scripts as a whole."""
    settings, prefix = routed(spark, folder), F.concat(F.lit("c"), F.col(KEY))
    by_page = J.page_requests(paged(spark, folder), settings, KEY, prefix)
    combined = J.combined_requests(paged(spark, folder), settings, KEY, prefix)
    texts = S.clean_scripts(documents(spark, folder, "text"))
    whole = J.document_requests(texts, settings, KEY, F.concat(F.lit("d"), F.col(KEY)))
    return by_page.unionByName(combined).unionByName(whole)


@_query("rejected_requests")
def rejected_requests(spark, folder):
    return J.rejected_requests(routed(spark, folder), "job_id")


@_query("document_srt")
def document_srt(spark, folder):
    """The subtitle file of every paged document that is read as a whole."""
    together = jobs(spark, folder).where(~F.col("separate_pages")).select(KEY).distinct()
    return R.srt_blocks(document_cues(spark, folder).join(together, KEY, "left_semi"), [KEY])


@_query("synthesis_outcomes")
def synthesis_outcomes(spark, folder):
    return J.synthesis_outcomes(paged(spark, folder), outcomes(spark, folder), KEY)


@_query("failed_pages")
def failed_pages(spark, folder):
    return J.failed_pages(paged(spark, folder), outcomes(spark, folder), KEY)


@_query("artifact_plan")
def artifact_plan(spark, folder):
    return A.artifact_plan(
        jobs(spark, folder), paged(spark, folder), KEY, F.concat(F.lit("c"), F.col(KEY))
    )


# Files ---------------------------------------------------------------------


@_query("file_inventory")
def file_inventory(spark, folder):
    """Saved web pages as files; a page asked for with a query is never found."""
    pages = web_pages(spark, folder)
    path = F.concat(F.regexp_extract("url", r"//([^?#]*)", 1), F.lit("-"), F.col(KEY), F.lit(".html"))
    files = pages.where(~F.col("url").contains("?")).select(
        path.alias("path"), F.octet_length("html").cast("bigint").alias("size")
    )
    found = lookup_files(pages.select(path.alias("path")), files)
    return found.select("path", "size", "size_mb", "suffix", "name", "exists")


@_query("files_in_order")
def files_in_order(spark, folder):
    """Every saved web page with its place in the order of all paths."""
    pages = web_pages(spark, folder)
    path = F.concat(F.regexp_extract("url", r"//([^?#]*)", 1), F.lit("-"), F.col(KEY), F.lit(".html"))
    return in_order(pages.select(path.alias("path")), "path", "position")


@_query("event_stamps")
def event_stamps(spark, folder):
    """The stamps of files and manifests made at the time of every event."""
    events = read_table(spark, folder, "events", "ts")
    time = F.col("ts").cast("timestamp_ntz")
    return events.select("event_id", file_stamp(time).alias("file_stamp"), iso_stamp(time).alias("created"))


@_query("output_layout")
def output_layout(spark, folder):
    """Audio of every page and one video for each document that has audio."""
    base, stamp = F.concat(F.lit("c"), F.col(KEY)), file_stamp(F.lit(CREATED).cast("timestamp_ntz"))
    audio = outcomes(spark, folder).withColumnRenamed("ok", "exists")
    videos = audio.groupBy(KEY).agg(F.max("exists").alias("exists")).withColumn(
        "path", F.concat(base, F.lit(".mp4"))
    )
    return A.output_layout(audio, KEY, base, stamp).unionByName(A.video_layout(videos, KEY, base, stamp))


@_query("unique_names")
def unique_names(spark, folder):
    """Documents of one source ask for one name; shorter texts took counters before."""
    base = F.col("source").alias("base")
    rows = documents(spark, folder, "source", "n_chars")
    requests = rows.select(F.col(KEY).alias("id"), base, F.lit("mp3").alias("extension"))
    taken = rows.where("n_chars < 40").select(
        base, F.lit("mp3").alias("extension"), F.col("n_chars").alias("counter")
    )
    return A.unique_names(requests, taken, file_stamp(F.lit(CREATED).cast("timestamp_ntz")))


@_query("concat_plan")
def concat_plan(spark, folder):
    return A.concat_plan(outcomes(spark, folder).where("ok"), KEY)


def _projects(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Jobs, pages, audio and videos of the projects that have manifests."""
    audio = outcomes(spark, folder).where("ok").select(KEY, "page_number", "path")
    videos = audio.groupBy(KEY).agg(F.concat(F.lit("c"), F.col(KEY), F.lit(".mp4")).alias("path"))
    videos = videos.join(jobs(spark, folder).where("output_type = 'both'").select(KEY), KEY, "left_semi")
    named = jobs(spark, folder).withColumns(
        {
            "project_name": F.when(F.col(KEY) % 5 != 0, F.concat(F.lit("c"), F.col(KEY))),
            "source_pdf": F.when(F.col(KEY) % 4 != 0, F.concat(F.lit("c"), F.col(KEY), F.lit(".pdf"))),
        }
    )
    wanted = named.join(paged_documents(spark, folder), KEY, "left_semi")
    return wanted, paged(spark, folder), audio, videos


@_query("project_manifest")
def project_manifest(spark, folder):
    return A.manifests(*_projects(spark, folder), KEY, CREATED)


@_query("manifest_files")
def manifest_files(spark, folder):
    """Manifests written as JSON documents, and the files they list read again."""
    target = f"{shared_folder(spark).rstrip('/')}/manifest-files-{uuid.uuid4().hex}"
    write_manifest_documents(A.manifest_blocks(*_projects(spark, folder), KEY, CREATED), target, "job_id")
    found = read_manifest_documents(spark, target, "job_id")
    return found.select(F.col("job_id").cast("bigint").alias("job_id"), "path")


@_query("manifest_roundtrip")
def manifest_roundtrip(spark, folder):
    """Manifests written as JSON lines to the shared folder and read again."""
    target = f"{shared_folder(spark).rstrip('/')}/manifests-{uuid.uuid4().hex}"
    write_manifests(project_manifest(spark, folder), target, "job_id")
    return read_manifests(spark, target).select(
        F.col("key").cast("bigint").alias("job_id"),
        "project_name",
        "source_pdf",
        "total_pages",
        "total_audio_files",
        "has_video",
        F.col("voice_config.engine").alias("engine"),
        F.col("output_config.audio_format").alias("audio_format"),
        F.array_join("file_list.audio_files", ",").alias("audio_files"),
        F.col("file_list.video_file").alias("video_file"),
        F.col("corrupt").isNull().alias("is_valid"),
    )
