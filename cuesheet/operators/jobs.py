"""Conversion jobs: defaults, checks, engine routing, requests, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.arrays import let
from cuesheet.functions.names import complete_file, dotted, page_file, suffix
from cuesheet.functions.packing import compose, pack_map, packed_chunks
from cuesheet.functions.segments import REQUEST_CHARS, request_chunks
from cuesheet.functions.text import is_blank
from cuesheet.functions.timecode import speech_rate
from cuesheet.operators.blocks import document_facts, explode_rows
from cuesheet.operators.lookup import lookup, lookup_roles, spread_join

# Settings of a job that names none, with their types.
DEFAULTS = {
    "engine": ("string", "pyttsx3"),
    "speed": ("double", 1.0),
    "pitch": ("int", 0),
    "language": ("string", "en"),
    "voice_id": ("string", None),
    "output_type": ("string", "audio"),
    "audio_format": ("string", "mp3"),
    "video_format": ("string", "mp4"),
    "audio_quality": ("string", "high"),
    "resolution": ("string", "1920x1080"),
    "fps": ("int", 24),
    "subtitles": ("boolean", False),
    "separate_pages": ("boolean", False),
    "extraction_method": ("string", "auto"),
}
# What a job may choose from, and its ranges.
ENGINES = ("pyttsx3", "gtts", "elevenlabs")
OUTPUT_TYPES = ("audio", "video", "both")
AUDIO_FORMATS = ("mp3", "wav")
EXTRACTION_METHODS = ("auto", "pymupdf", "pdfplumber")
SCRIPT_FORMATS = (".pdf",)
SPEED_RANGE = (0.5, 2.0)
PITCH_RANGE = (-50, 50)
SLOW_SPEED = 0.8
PATHS = {
    "pdf_input_dir": "pdf_scripts",
    "audio_output_dir": "audio_output",
    "video_output_dir": "video_output",
    "temp_dir": "temp",
}


def with_defaults(overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs with every known setting; unknown columns are dropped."""
    given = set(overrides.columns)

    def setting(name: str) -> Column:
        kind, default = DEFAULTS[name]
        value = F.lit(default).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), value) if name in given else value).alias(name)

    return overrides.select(*keys, *[setting(name) for name in DEFAULTS])


def resolution(text: Column) -> Column:
    """`struct(width, height)` of WIDTHxHEIGHT; null unless both are positive."""
    number = r"\s*\+?(?:\d+_)*\d+\s*"
    bare = F.regexp_replace(F.when(text.rlike(rf"^{number}x{number}\z"), text), r"[_+\s]", "")

    def size(halves: Column) -> Column:
        width, height = (F.get(halves, F.lit(i)).try_cast("bigint") for i in (0, 1))
        return F.struct(width.alias("width"), height.alias("height"))

    def if_positive(size: Column) -> Column:
        return F.when((size["width"] > 0) & (size["height"] > 0), size)

    return let(let(F.split(bare, "x"), size), if_positive)


def voice_config() -> Column:
    return F.struct("engine", "speed", "pitch", "language", "voice_id")


def output_config() -> Column:
    size = resolution(F.col("resolution"))
    return F.struct(
        "audio_format",
        "video_format",
        "audio_quality",
        F.array(size["width"], size["height"]).alias("video_resolution"),
        "fps",
    )


def config_snapshot() -> Column:
    """All settings of a job as JSON text; unset ones are written as null."""
    paths = F.struct(*[F.lit(folder).alias(name) for name, folder in PATHS.items()])
    snapshot = F.struct(
        voice_config().alias("voice"), output_config().alias("output"), paths.alias("paths")
    )
    return F.to_json(snapshot, {"ignoreNullFields": "false"})


def format_gate(files: DataFrame, path: str = "path") -> DataFrame:
    """Mark files whose format is not supported, instead of failing on them."""
    fits = F.lower(suffix(F.col(path))).isin(*SCRIPT_FORMATS)
    reason = F.when(~fits, F.concat(F.lit("Unsupported file format: "), suffix(F.col(path))))
    return files.withColumns({"is_valid": fits, "reject_reason": reason})


def validate(jobs: DataFrame, existing: DataFrame, job: str = "job_id") -> DataFrame:
    """The first rule each job breaks as `reject_reason`; null if it may run.

    `existing` is the inventory of paths, each once; `job` tells jobs apart.
    """
    roles = {"__input": "input_path", "__background": "background"}
    found = lookup_roles(jobs, existing, "path", F.lit(True), roles, job)
    rules = [
        ("unknown engine", ~F.col("engine").isin(*ENGINES)),
        ("unknown output type", ~F.col("output_type").isin(*OUTPUT_TYPES)),
        ("unknown audio format", ~F.col("audio_format").isin(*AUDIO_FORMATS)),
        ("unknown extraction method", ~F.col("extraction_method").isin(*EXTRACTION_METHODS)),
        ("input not found", F.col("__input").isNull()),
        ("input is no script", ~F.lower(suffix(F.col("input_path"))).isin(*SCRIPT_FORMATS)),
        ("speed out of range", ~F.col("speed").between(*SPEED_RANGE)),
        ("pitch out of range", ~F.col("pitch").between(*PITCH_RANGE)),
        ("invalid resolution", resolution(F.col("resolution")).isNull()),
        (
            "background not found",
            (F.coalesce("background", F.lit("")) != "") & F.col("__background").isNull(),
        ),
    ]
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])
    return found.select(*jobs.columns, reason.alias("reject_reason"))


def route_engines(jobs: DataFrame, engines: DataFrame, job: str = "job_id") -> DataFrame:
    """Engine that runs each job: the one asked for, or the first available.

    `engines` is the registry (name, ordinal, available). Unknown names fail.
    """
    fallback = engines.where("available").agg(F.min_by("name", "ordinal")).scalar()
    registry = engines.select(F.col("name").alias("engine"), F.col("available").alias("__available"))
    routed = lookup(jobs, registry, "engine", job).withColumn("__first", fallback)
    unknown = F.col("__available").isNull()
    choice = F.when(F.col("__available"), F.col("engine")).when(~unknown, F.col("__first"))
    reason = (
        F.when(unknown, "unknown engine")
        .when(F.col("__available"), "requested")
        .when(F.col("__first").isNotNull(), "fallback")
        .otherwise("none available")
    )
    return routed.select(
        *jobs.columns, choice.alias("routed_engine"), reason.alias("routing")
    )


def match_voices(jobs: DataFrame, voices: DataFrame, job: str = "job_id") -> DataFrame:
    """First voice of the job's engine, in order, whose id contains the voice asked for.

    Containment becomes equality: every voice (id, engine, ordinal) is listed
    under the substrings of its short id that are as long as some request, each
    substring keeps its first voice, and jobs look their request up. A job that
    asks for none, or finds none, has a null voice.
    """
    lower_id = F.lower("id")

    def asked(engine: str, name: Column) -> Column:
        return F.concat(F.col(engine), F.lit("\0"), name)

    sizes = jobs.agg(F.collect_set(F.length("voice_id"))).scalar()
    pieces = F.flatten(
        F.transform(
            F.filter("__sizes", lambda size: (size > 0) & (size <= F.length(lower_id))),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.length(lower_id) - size + 1),
                lambda start: F.substring(lower_id, start, size),
            ),
        )
    )
    short = voices.where(F.length("id") > 0).withColumn("__sizes", sizes)
    listed = explode_rows(short, F.array_distinct(pieces), "__piece")
    index = (
        listed.groupBy(asked("engine", F.col("__piece")).alias("__asked"))
        .agg(F.min_by("id", "ordinal").alias("matched_voice"))
    )
    wanted = jobs.withColumn("__asked", asked("engine", F.lower("voice_id")))
    return lookup(wanted, index, "__asked", job).drop("__asked")


def _requests(rows: DataFrame, key: str, number: Column, filename: Column) -> DataFrame:
    """Requests of the rows that have text.

    Blank rows give no array element instead of being filtered: Spark would
    push a filter on the text below the cleaning and do that twice.
    """
    text = F.col("text")
    request = F.struct(
        number.alias("page_number"),
        filename.alias("filename"),
        "routed_engine",
        speech_rate(F.col("speed")).alias("rate"),
        (F.col("speed") < SLOW_SPEED).alias("slow"),
        F.length(text).alias("n_chars"),
        F.size(request_chunks(text)).alias("n_chunks"),
    )
    wanted = F.array(F.when(~is_blank(text), request))
    return explode_rows(rows, wanted, "request").select("job_id", key, "request.*")


def rejected_requests(jobs: DataFrame, key: str) -> DataFrame:
    """Jobs that get no synthesis request, with the reason: those whose engine
    is unknown or none is available, and those for video alone."""
    reason = F.when(F.col("routing").isin("unknown engine", "none available"), F.col("routing")).when(
        ~_speaks(), "no audio wanted"
    )
    return jobs.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def _speaks() -> Column:
    return F.coalesce(F.col("output_type").isin("audio", "both"), F.lit(False))


def _able(jobs: DataFrame) -> DataFrame:
    """Jobs that ask for speech and have an engine for it."""
    return jobs.where(_speaks() & F.col("routed_engine").isNotNull())


def page_requests(pages: DataFrame, jobs: DataFrame, key: str, prefix: Column) -> DataFrame:
    """One synthesis request per page that has text, for jobs with separate pages."""
    settings = _able(jobs).where("separate_pages").select("job_id", key, "routed_engine", "speed")
    joined = spread_join(pages, settings, key, "page_number")
    number = F.col("page_number")
    return _requests(joined, key, number, page_file(prefix, number, F.lit(".mp3")))


def document_requests(texts: DataFrame, jobs: DataFrame, key: str, prefix: Column) -> DataFrame:
    """One synthesis request per document, for texts that are one row each."""
    joined = texts.join(_able(jobs).select("job_id", key, "routed_engine", "speed", "audio_format"), key)
    name = complete_file(prefix, dotted(F.col("audio_format")))
    return _requests(joined, key, F.lit(None).cast("int"), name)


# Bits of a piece's number dropped at each level of `packed_documents`.
_PIECES, _MAPS = 12, 10


def packed_documents(pages: DataFrame, keys: DataFrame, key: str, max_chars: int = REQUEST_CHARS) -> DataFrame:
    """(key, n_chars, n_chunks) of the texts that the pages of each document in
    `keys` make, joined by a space, without joining them.

    A page ends in the space that joins it to the next, so each page is cut at
    `. ` alone; only lengths leave it. Pieces that cross pages are summed up by
    their number, every 4,096 pieces become one map of the packer's fill level,
    and maps are composed by the thousand before those that are left meet by
    document. Documents without any text are left out.
    """
    text = F.col("text")
    cut = F.transform(F.split(F.concat(text, F.lit(" ")), r"\. ", -1), F.length)
    known = pages.where(text.isNotNull()).select(
        key,
        "page_number",
        F.length(text).cast("bigint").alias("__length"),
        (~is_blank(text)).cast("bigint").alias("__solid"),
        cut.alias("__cut"),
        text.endswith(".").alias("__dot"),
    )
    placed = document_facts(
        known,
        key,
        "page_number",
        {
            "page": F.lit(1).cast("bigint"),
            "chars": F.col("__length"),
            "solid": F.col("__solid"),
            "breaks": (F.size("__cut") - 1).cast("bigint"),
        },
        keys.select(key).distinct(),
        "inner",
    ).where(F.col("solid_total") > 0)
    # No space follows the last page: its last piece is shorter by that, or, if
    # the page ends in a full stop, is none, and the one before keeps the stop.
    final = F.col("page_before") + 1 == F.col("page_total")
    left = F.size("__cut") - F.col("__at")
    length = F.col("__piece") + F.when(final & F.col("__dot") & (left == 2), 1).when(
        final & ~F.col("__dot") & (left == 1), -1
    ).otherwise(0)
    pieces = (
        explode_rows(placed, F.col("__cut"), "__piece", "__at")
        .where(~(final & F.col("__dot") & (left == 1)))
        .select(
            key,
            (F.col("breaks_before") + F.col("__at")).alias("__no"),
            length.cast("bigint").alias("__piece"),
            (F.col("chars_total") + F.col("page_total") - 1).alias("n_chars"),
        )
    )
    whole = pieces.groupBy(key, "__no").agg(F.sum("__piece").alias("__piece"), F.first("n_chars").alias("n_chars"))

    def in_order(value: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("__no", value)))
        return F.transform(rows, lambda r: r[value])

    def level(rows: DataFrame, bits: int, value: Column, name: str) -> DataFrame:
        grouped = rows.groupBy(key, F.shiftright("__no", bits).alias("__block")).agg(
            value.alias(name), F.first("n_chars").alias("n_chars")
        )
        return grouped.withColumnRenamed("__block", "__no")

    lengths = level(whole, _PIECES, in_order("__piece"), "__lengths")
    maps = lengths.select(key, "__no", "n_chars", F.expr(pack_map("__lengths", max_chars, 2)).alias("__map"))
    for _ in range(2):
        grouped = level(maps, _MAPS, in_order("__map"), "__maps")
        maps = grouped.select(key, "__no", "n_chars", F.expr(compose("__maps", max_chars)).alias("__map"))
    met = maps.groupBy(key).agg(in_order("__map").alias("__maps"), F.first("n_chars").alias("n_chars"))
    n_chunks = F.when(F.col("n_chars") <= max_chars, 1).otherwise(F.expr(packed_chunks("__maps", max_chars)))
    return met.select(key, "n_chars", n_chunks.alias("n_chunks"))


def combined_requests(pages: DataFrame, jobs: DataFrame, key: str, prefix: Column) -> DataFrame:
    """One synthesis request per paged document whose pages are read together.

    It tells how long the text is and in how many calls it is spoken; the text
    itself is never one value.
    """
    together = _able(jobs).where(~F.col("separate_pages"))
    sizes = packed_documents(pages, together, key)
    settings = together.select("job_id", key, "routed_engine", "speed", "audio_format")
    return sizes.join(settings, key).select(
        "job_id",
        key,
        F.lit(None).cast("int").alias("page_number"),
        complete_file(prefix, dotted(F.col("audio_format"))).alias("filename"),
        "routed_engine",
        speech_rate(F.col("speed")).alias("rate"),
        (F.col("speed") < SLOW_SPEED).alias("slow"),
        F.col("n_chars").cast("int").alias("n_chars"),
        F.col("n_chunks").cast("int").alias("n_chunks"),
    )


def synthesis_outcomes(requests: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """How many requests of a document gave audio; it fails only if none did."""
    done = _with_outcomes(requests, outcomes, key)
    ok = F.count_if("ok")
    return done.groupBy(key).agg(
        F.count("*").alias("n_requests"),
        ok.alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.min(F.when(~F.col("ok"), F.col("page_number"))).alias("first_failed_page"),
        (ok > 0).alias("doc_ok"),
    )


def failed_pages(requests: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """The requests without audio, one row each."""
    return _with_outcomes(requests, outcomes, key).where(~F.col("ok")).select(key, "page_number")


def _with_outcomes(requests: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    on = [key, "page_number"]
    return (
        requests.select(*on)
        .join(outcomes.select(*on, F.col("ok").alias("__ok")), on, "left")
        .select(*on, F.coalesce("__ok", F.lit(False)).alias("ok"))
    )
