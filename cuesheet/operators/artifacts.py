"""Files a job makes: plans, names, folders, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.names import complete_file, dotted, page_file, suffix, timestamped, without_suffix
from cuesheet.operators.blocks import document_facts, explode_rows
from cuesheet.operators.jobs import output_config, voice_config
from cuesheet.operators.lookup import spread_join


def _one() -> Column:
    return F.lit(1).cast("bigint")


def artifact_plan(jobs: DataFrame, pages: DataFrame, key: str, prefix: Column) -> DataFrame:
    """Every file the jobs are expected to make, one row each, by `job_id`.

    Pages are counted first and jobs come to them afterwards, so that several
    jobs on one document do not disturb its numbers.

    Video and subtitles are made from audio, and audio is made only where the
    output is audio or both: a job for video alone makes nothing.
    """
    has_audio = F.col("output_type").isin("audio", "both")
    settings = jobs.select(
        "job_id", key, "output_type", "audio_format", "video_format", "subtitles", "separate_pages"
    ).where(has_audio)
    counted = document_facts(pages.select(key, "page_number"), key, "page_number", {"page": _one()})
    placed = spread_join(counted, settings, key, "page_number")
    ordinal = F.col("page_before") + 1

    def artifact(wanted: Column, kind: str, number: Column, name: Column) -> Column:
        row = F.struct(
            F.lit(kind).alias("kind"), number.cast("int").alias("page_number"), name.alias("filename")
        )
        return F.when(wanted, row)

    # What a document makes once comes from its first page.
    first, apart, subtitled = ordinal == 1, F.col("separate_pages"), F.col("subtitles")
    number, none = F.col("page_number"), F.lit(None)
    page_audio = page_file(prefix, number, F.lit(".mp3"))
    page_srt = page_file(F.concat(prefix, F.lit("_page")), ordinal, F.lit(".srt"))
    audio = complete_file(prefix, dotted(F.col("audio_format")))
    video = complete_file(prefix, dotted(F.col("video_format")))
    srt = complete_file(prefix, F.lit(".srt"))
    plan = F.array_compact(
        F.array(
            artifact(apart, "audio", number, page_audio),
            artifact(first & ~apart, "audio", none, audio),
            artifact(first & (F.col("output_type") == "both"), "video", none, video),
            artifact(apart & subtitled, "srt", number, page_srt),
            artifact(first & ~apart & subtitled, "srt", none, srt),
        )
    )
    return explode_rows(placed, plan, "artifact").select("job_id", key, "artifact.*")


def page_subtitle_names(pages: DataFrame, key: str, prefix: Column) -> DataFrame:
    """Pages with the name of their own subtitle file, which counts the pages
    that are left and not their numbers."""
    numbered = document_facts(pages, key, "page_number", {"page": _one()})
    name = page_file(F.concat(prefix, F.lit("_page")), F.col("page_before") + 1, F.lit(".srt"))
    return numbered.withColumn("filename", name).drop("page_before", "page_total")


def output_layout(audio: DataFrame, key: str, base: Column, stamp: Column) -> DataFrame:
    """Where the audio files of a project go.

    A file that is missing is left out but still uses up its number.
    """
    numbered = document_facts(audio, key, "page_number", {"file": _one()})
    name = page_file(
        F.concat(base, F.lit("_page")), F.col("file_before") + 1, suffix(F.col("path"))
    )
    return numbered.where("exists").select(
        key, F.col("path").alias("source"), F.concat(_project(base, stamp), F.lit("/audio/"), name).alias("target")
    )


def video_layout(videos: DataFrame, key: str, base: Column, stamp: Column) -> DataFrame:
    name = complete_file(base, suffix(F.col("path")))
    return videos.where("exists").select(
        key, F.col("path").alias("source"), F.concat(_project(base, stamp), F.lit("/video/"), name).alias("target")
    )


def _project(base: Column, stamp: Column) -> Column:
    return F.concat(base, F.lit("_"), stamp)


def unique_names(requests: DataFrame, taken: DataFrame, stamp: Column) -> DataFrame:
    """A name of its own for every request: the stem of its base, the stamp and
    a counter where it needs one.

    `requests` holds (id, base, extension) in order of `id`; `taken` holds
    (base, extension, counter) of names that exist, 0 for one without counter.
    The first request of a name takes the first counter that is free, and so
    on. Requests and taken counters are ranked together, in blocks, however
    many a name has: with `counter - rank` free places below it, a taken
    counter is passed by every request ranked from there on.
    """
    stem = without_suffix(F.col("base"))
    name = F.concat_ws("\0", stem, dotted(F.col("extension")))
    place = F.col("__place")
    asked = requests.select(
        F.struct(name.alias("name"), F.lit(False).alias("held")).alias("__name"),
        F.col("id").cast("bigint").alias("__place"),
        F.struct("id", stem.alias("stem"), "extension").alias("__request"),
    )
    held = taken.select(
        F.struct(name.alias("name"), F.lit(True).alias("held")).alias("__name"), F.col("counter").cast("bigint").alias("__place")
    ).distinct()
    both = asked.unionByName(held, allowMissingColumns=True)
    ranked = document_facts(both, "__name", "__place", {"n": _one()}, sparse=True)
    # Requests stand at odd places by rank, taken counters before the request they stop first.
    rank, is_held = F.col("n_before"), F.col("__name.held")
    line = ranked.groupBy(
        F.col("__name.name").alias("__name"), F.when(is_held, (place - rank) * 2).otherwise(rank * 2 + 1).alias("__at")
    ).agg(F.count_if(is_held).alias("passed"), F.first("__request").alias("__request"))
    counted = document_facts(line, "__name", "__at", {"skip": F.col("passed")}, sparse=True)
    request = F.col("__request")
    counter = F.shiftright("__at", 1) + F.col("skip_before")
    return counted.where(request.isNotNull()).select(
        request["id"].alias("id"), timestamped(request["stem"], stamp, counter, request["extension"]).alias("filename")
    )


def concat_plan(artifacts: DataFrame, key: str) -> DataFrame:
    """The files to join for each document, one row each, numbered from 1; a
    document's only file is copied."""
    counted = document_facts(artifacts, key, "page_number", {"file": _one()})
    action = F.when(F.col("file_total") == 1, "copy").otherwise("concat")
    return counted.select(
        key,
        (F.col("file_before") + 1).alias("position"),
        action.alias("action"),
        F.col("file_total").alias("n_files"),
        "path",
    )


def _described(jobs: DataFrame, pages: DataFrame, videos: DataFrame, key: str) -> DataFrame:
    """Jobs with `pages`, how many pages their document has, and its `video`."""
    page_counts = pages.groupBy(key).agg(F.count("*").alias("pages"))
    video = videos.groupBy(key).agg(F.max("path").alias("video"))
    return jobs.join(page_counts, key, "left").join(video, key, "left")


def _head(created: Column) -> list[Column]:
    """The fields of a manifest before its lists."""
    return [
        created.alias("created"),
        F.coalesce("project_name", F.lit("Unnamed Project")).alias("project_name"),
        F.coalesce("source_pdf", F.lit("")).alias("source_pdf"),
        F.coalesce("pages", F.lit(0)).alias("total_pages"),
        F.coalesce("files", F.lit(0)).alias("total_audio_files"),
        F.col("video").isNotNull().alias("has_video"),
        voice_config().alias("voice_config"),
        output_config().alias("output_config"),
    ]


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def manifests(
    jobs: DataFrame, pages: DataFrame, audio: DataFrame, videos: DataFrame, key: str, created: str
) -> DataFrame:
    """Project manifests as JSON, one for each job.

    `jobs` holds the settings and project_name and source_pdf; absent values
    get their defaults. A manifest is one document with all its file names.
    """
    listed = audio.groupBy(key).agg(
        F.count("*").alias("files"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("page_number", "path"))), lambda f: f["path"]
        ).alias("audio_files"),
    )
    joined = _described(jobs, pages, videos, key).join(listed, key, "left")
    lists = F.struct(
        F.coalesce("audio_files", F.array().cast("array<string>")).alias("audio_files"),
        F.col("video").alias("video_file"),
    )
    return joined.select("job_id", key, _json(F.struct(*_head(F.lit(created)), lists.alias("file_list"))).alias("manifest"))


def manifest_blocks(
    jobs: DataFrame, pages: DataFrame, audio: DataFrame, videos: DataFrame, key: str, created: str
) -> DataFrame:
    """The same manifests as rows (job_id, index, block), in order of `index`: a
    head, a line per file, an end. Their blocks one after the other are a JSON
    document, which is never one value: so it may list any number of files."""
    counts = audio.groupBy(key).agg(F.count("*").alias("files"))
    told = _described(jobs, pages, videos, key).join(counts, key, "left")
    head = _json(F.struct(*_head(F.lit(created))))
    opening = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"file_list":{"audio_files":[\n'))
    video = F.coalesce(_json(F.struct(F.col("video").alias("v"))), F.lit('{"v":null}'))
    ending = F.concat(F.lit('],"video_file":'), video.substr(F.lit(6), F.length(video) - 6), F.lit("}}\n"))
    frame = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("index"), opening.alias("block")),
        F.struct(F.lit(1 << 62).alias("index"), ending.alias("block")),
    )
    frames = explode_rows(told.select("job_id", frame.alias("__frame")), F.col("__frame"), "__part")
    listed = document_facts(audio.select(key, "page_number", "path"), key, "page_number", {"file": _one()})
    files = spread_join(listed, jobs.select("job_id", key), key, "page_number")
    path = _json(F.struct(F.col("path").alias("p")))
    comma = F.when(F.col("file_before") + 1 == F.col("file_total"), "\n").otherwise(",\n")
    line = F.concat(path.substr(F.lit(6), F.length(path) - 6), comma)
    return frames.select("job_id", "__part.index", "__part.block").unionByName(
        files.select("job_id", F.col("page_number").cast("bigint").alias("index"), line.alias("block"))
    )
