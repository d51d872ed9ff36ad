"""Documents written by tasks that commit, or fail."""

import pytest
from pyspark.sql import functions as F

from cuesheet.sources import sink
from cuesheet.sources.sink import read_documents, write_documents


def files(folder):
    return {p.name: p.read_bytes().decode() for p in folder.glob("part-*/*")}


def test_documents_are_whole_and_in_order(spark, tmp_path):
    rows = [(d, i, f"{d}:{i} é\r\n") for d in range(300) for i in reversed(range(d % 5 + 1))]
    blocks = spark.createDataFrame(rows, "doc_id long, index int, block string").repartition(7)
    want = {f"{d}.srt": "".join(f"{d}:{i} é\r\n" for i in range(d % 5 + 1)) for d in range(300)}
    for _ in range(2):  # the second time in the place of the first
        write_documents(blocks, str(tmp_path), "doc_id", ".srt")
        assert files(tmp_path) == want
        assert {p.name[:5] for p in tmp_path.iterdir()} == {"part-"} and len(list(tmp_path.iterdir())) <= 4


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    write_documents(spark.createDataFrame([("a/b", 0, "old")], "k string, index int, block string"), str(tmp_path), "k", ".txt")
    broken = spark.range(200).select(
        F.col("id").cast("string").alias("k"), F.lit(0).alias("index"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("new").alias("block")
    )
    with pytest.raises(Exception):
        write_documents(broken, str(tmp_path), "k", ".txt")
    assert files(tmp_path) == {"a%2Fb.txt": "old"} and len(list(tmp_path.iterdir())) == 1
    write_documents(broken.limit(0), str(tmp_path), "k", ".txt")
    assert files(tmp_path) == {}


def test_documents_are_read_without_a_file_list_on_the_driver(spark, tmp_path):
    """Tasks by the bytes there are, not by the number of files; empty files and odd names too."""
    n = 3_000
    blocks = spark.range(n, numPartitions=3).select(
        F.concat(F.lit("a/b é_"), "id").alias("k"), F.lit(0).alias("index"), F.when(F.col("id") % 100 > 0, F.concat(F.lit("﻿é\r\n"), "id")).otherwise("").alias("block")
    )
    write_documents(blocks, str(tmp_path), "k", ".srt")
    read = read_documents(spark, f"file://{tmp_path}", ".srt")
    assert {r.key: r.value for r in read.collect()} == {f"a/b é_{i}": f"﻿é\r\n{i}" if i % 100 else "" for i in range(n)}
    assert read.rdd.getNumPartitions() == len(list(tmp_path.iterdir())) <= 4
    write_documents(blocks.limit(0), str(tmp_path), "k", ".srt")
    assert read_documents(spark, str(tmp_path), ".srt").collect() == []


@pytest.mark.parametrize("shares", [1, 3])
def test_lines_of_a_long_file_are_read_once_by_many_tasks(tmp_path, monkeypatch, shares):
    for name, n in {"1.json": 5_000, "2.json": 1, "3.json": 0}.items():
        (tmp_path / name).write_bytes("".join(f"{i} é{'x' * (i % 50)}\n" for i in range(n)).encode())
    monkeypatch.setattr(sink, "RANGE_BYTES", 997)
    monkeypatch.setattr(sink, "BATCH_CHARS", 5_000)
    reader = sink._Reader(str(tmp_path.parent), ".json", True)
    told = [[r for b in reader.read(sink._Share(str(tmp_path), i, shares)) for r in zip(*b.to_pydict().values())] for i in range(shares)]
    want = [("1", f"{i} é{'x' * (i % 50)}") for i in range(5_000)] + [("2", "0 é")]
    assert sorted(sum(told, [])) == sorted(want)
    assert min(map(len, told)) > 5_000 // shares // 2


def test_whole_documents_are_written_where_they_are_made(spark, tmp_path):
    rows = spark.range(600, numPartitions=3).select(F.col("id").alias("k"), F.lit(0).alias("index"), F.concat(F.lit("t"), "id").alias("block"))
    write_documents(rows, str(tmp_path), "k", ".txt", whole=True)
    assert files(tmp_path) == {f"{i}.txt": f"t{i}" for i in range(600)}
    assert sorted(len(list(p.iterdir())) for p in tmp_path.iterdir()) == [200, 200, 200]
    assert {int(r.key): r.value for r in read_documents(spark, str(tmp_path), ".txt").collect()} == {i: f"t{i}" for i in range(600)}
