"""Many small documents on disk: written as files by name, in one folder per
task, there only once all tasks are done; read again folder by folder."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cuesheet.session import ship_package

SCHEMA = "key string, value string"

# Bytes of files that a task reads, bytes of a long file that are
# read as one range, and characters of rows that are passed on at once.
SHARE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_CHARS = 4 << 20

_STAGING = "_staging"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    size: int


class _Writer(DataSourceWriter):
    """Every task writes into a staging folder of its own, whose name only a
    task that was not lost tells the driver; the driver moves these into place."""

    def __init__(self, root: str, suffix: str, overwrite: bool):
        self.root, self.suffix, self.overwrite = root, suffix, overwrite
        self.staging = os.path.join(root, f"{_STAGING}-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> _Written:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(folder)
        name = file = None
        files = size = 0
        try:
            for key, block in rows:
                if name is None or key != name:
                    if file:
                        size += file.tell()
                        file.close()
                    name, files = key, files + 1
                    file = open(os.path.join(folder, quote(str(key), safe="") + self.suffix), "x", encoding="utf-8", newline="")
                file.write(block)
            if file:
                size += file.tell()
        finally:
            if file:
                file.close()
        return _Written(folder, files, size)

    def commit(self, messages: list[_Written | None]) -> None:
        os.makedirs(self.root, exist_ok=True)
        if self.overwrite:
            for old in os.listdir(self.root):
                if old.startswith("part-"):
                    shutil.rmtree(os.path.join(self.root, old))
        run = uuid.uuid4().hex[:12]
        for i, message in enumerate(messages):
            if message is not None and message.files:
                # The name tells a reader how many tasks the folder is worth.
                os.rename(message.folder, os.path.join(self.root, f"part-{i:05d}-{run}-{message.size}"))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


@dataclass
class _Share(InputPartition):
    """The share of a folder that one task reads, of so many."""

    folder: str
    number: int
    shares: int


class _Reader(DataSourceReader):
    """Only the folders are looked at where the read is planned. Each task
    lists the files of its folder, however many, and reads its share of them."""

    def __init__(self, root: str, suffix: str, lines: bool):
        self.root, self.suffix, self.lines = root, suffix, lines

    def partitions(self) -> list[_Share]:
        parts = []
        for name in sorted(os.listdir(self.root)):
            if name.startswith("part-"):
                size = re.search(r"-(\d+)$", name)
                shares = 1 + int(size[1]) // SHARE_BYTES if size else 1
                parts += [_Share(os.path.join(self.root, name), i, shares) for i in range(shares)]
        return parts

    def read(self, partition: _Share | None) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for key, value in self._rows(partition) if partition else ():  # none without parts
            keys.append(key)
            values.append(value)
            held += len(key) + len(value) + 16
            if held >= BATCH_CHARS:
                yield _batch(keys, values)
                keys, values, held = [], [], 0
        if keys:
            yield _batch(keys, values)

    def _rows(self, share: _Share) -> Iterator[tuple[str, str]]:
        for i, name in enumerate(sorted(n for n in os.listdir(share.folder) if n.endswith(self.suffix))):
            path, key = os.path.join(share.folder, name), unquote(name[: len(name) - len(self.suffix)])
            if self.lines:
                for n in range((share.number - i) % share.shares, 1 + os.path.getsize(path) // RANGE_BYTES, share.shares):
                    for line in _lines(path, n * RANGE_BYTES, (n + 1) * RANGE_BYTES):
                        yield key, line
            elif i % share.shares == share.number:
                with open(path, "rb") as file:
                    yield key, file.read().decode("utf-8")


def _lines(path: str, start: int, end: int) -> Iterator[str]:
    """The lines that begin in a range of bytes, without their line feeds."""
    with open(path, "rb") as file:
        if start:
            file.seek(start - 1)
            file.readline()
        while file.tell() < end and (line := file.readline()):
            yield line.removesuffix(b"\n").decode("utf-8")


def _batch(keys: list[str], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])


class DocumentFiles(DataSource):
    """Format `document_files`. Option `path`: a folder that all executors see;
    option `suffix`: what file names end in. Written are rows (key, block), those
    of a key one after the other. Read are rows (key, value): a file each, or
    with the option `lines` a line each, those of a long file by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = re.sub(r"^file:/+", "/", self.options["path"])
        if ":" in path.split("/")[0]:
            raise ValueError("document_files takes a mounted folder")
        return path

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), self.options.get("suffix", ""), self.options.get("lines", "false") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path(), self.options.get("suffix", ""), overwrite)


def write_documents(blocks: DataFrame, folder: str, key: str, suffix: str, whole: bool = False) -> None:
    """One file per key with its blocks in order of `index`, in a folder per
    task, in the place of those that were written there before.

    `blocks` holds (key, index, block). They are sorted on disk and written as
    they come; a document is never one value. A task that fails, or is run
    twice, leaves no file: folders are put in place once all tasks are done.
    With `whole`, rows that are a document each are written by the tasks that
    make them, without a shuffle of all texts.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    spark.dataSource.register(DocumentFiles)
    together = blocks if whole else blocks.repartition(key)
    ordered = together.sortWithinPartitions(key, "index").select(key, "block")
    ordered.write.format("document_files").mode("overwrite").option("path", folder).option("suffix", suffix).save()


def read_documents(spark: SparkSession, folder: str, suffix: str, lines: bool = False) -> DataFrame:
    """(key, value) of the documents that `write_documents` wrote there, a row
    each, or with `lines` a row for each of their lines.

    No file is listed on the driver, and a task reads many: their number costs
    neither memory there nor tasks.
    """
    ship_package(spark)
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").option("path", folder).option("suffix", suffix).option("lines", lines).load()
