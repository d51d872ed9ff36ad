"""Listing a mounted folder with all its files, also empty and hidden ones."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuesheet.session import ship_package

SCHEMA = "path string, size bigint, modified timestamp, is_file boolean, is_dir boolean"


@dataclass
class _Part(InputPartition):
    """A folder, and whether what is below its own folders is listed here too."""

    folder: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self) -> list[_Part]:
        """The folder itself and each folder in it and below that: two levels
        are looked at here, what lies deeper by tasks."""
        if not os.path.isdir(self.root):
            return []
        parts = [_Part(self.root, False)]
        for name in _folders(self.root):
            parts.append(_Part(name, False))
            parts += [_Part(inner, True) for inner in _folders(name)]
        return parts

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        for folder, names, files in os.walk(partition.folder) if partition else ():  # none without parts
            if not partition.deep:
                names.clear()
            here = [(folder, True)] if folder != self.root else []
            for path, is_dir in here + [(os.path.join(folder, f), False) for f in files]:
                if not path.endswith(self.suffix):
                    continue
                try:
                    told = os.stat(path)
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
                when = datetime.datetime.fromtimestamp(told.st_mtime, datetime.timezone.utc)
                yield path, told.st_size, when, not is_dir and os.path.isfile(path), is_dir


def _folders(folder: str) -> list[str]:
    with os.scandir(folder) as entries:
        return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))


class FileTree(DataSource):
    """Format `file_tree`. Option `path`: a folder that all executors see;
    option `suffix`: what paths end in."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = re.sub(r"^file:/+", "/", self.options["path"])
        return _Reader(path.rstrip("/") or "/", self.options.get("suffix", ""))


def list_tree(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """Files and folders below a mounted folder whose paths end in `suffix`:
    path, size, modified, is_file, is_dir; none if it is missing.

    Unlike Spark's own file scan this has files of no bytes and names that
    start with `_` or `.`. Folders below the second level are walked by tasks.
    """
    ship_package(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("path", folder).option("suffix", suffix).load()
