"""Project manifests in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.sources.sink import read_documents, write_documents
from cuesheet.sources.subtitles import write_subtitles

SCHEMA = """
    key string, created string, project_name string, source_pdf string, total_pages bigint,
    total_audio_files bigint, has_video boolean,
    voice_config struct<engine: string, speed: double, pitch: int, language: string, voice_id: string>,
    output_config struct<audio_format: string, video_format: string, audio_quality: string,
        video_resolution: array<bigint>, fps: int>,
    file_list struct<audio_files: array<string>, video_file: string>
"""


def write_manifests(manifests: DataFrame, folder: str, key: str) -> None:
    """One JSON line for each manifest, with its key as the first field."""
    opening = F.to_json(F.struct(F.col(key).alias("key")), {"ignoreNullFields": "false"})
    line = F.concat(
        opening.substr(F.lit(1), F.length(opening) - 1), F.lit(","), F.substring("manifest", 2, 1 << 30)
    )
    manifests.select(line.alias("value")).write.mode("overwrite").text(folder)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests as columns, the key as text, and the line itself in `corrupt` where it is no manifest."""
    return (
        spark.read.schema(f"{SCHEMA}, corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(folder)
    )


def write_manifest_files(blocks: DataFrame, folder: str, key: str) -> None:
    """One JSON document per manifest, from (key, index, block) rows, in a folder
    of its own: sorted on disk and written block by block. A store takes long
    to make folders: many manifests go through `write_manifest_documents`."""
    write_subtitles(blocks, folder, key)


def read_manifest_files(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, path) of the audio files that the manifests written so list, one
    row each. A file is a line: a long manifest is read by many tasks."""
    return _listed(spark.read.text(folder), key)


def write_manifest_documents(blocks: DataFrame, folder: str, key: str) -> None:
    """The same documents in a mounted folder, `<key>.json`, those of a task in
    one folder."""
    write_documents(blocks, folder, key, ".json")


def read_manifest_documents(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """As `read_manifest_files`, the key as text."""
    return _listed(read_documents(spark, folder, ".json", lines=True).withColumnRenamed("key", key), key)


def _listed(lines: DataFrame, key: str) -> DataFrame:
    name = F.regexp_extract("value", r"^(\".*\"),?$", 1)
    return lines.where(F.col("value").startswith('"')).select(
        key, F.from_json(F.concat(F.lit('{"p":'), name, F.lit("}")), "p string")["p"].alias("path")
    )
