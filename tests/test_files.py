import json

from cuesheet.sources.files import file_info, find_files, lookup_files
from pyspark.sql import functions as F

from cuesheet.operators import artifacts as A
from cuesheet.operators import jobs as J
from cuesheet.sources.manifests import (
    read_manifest_documents,
    read_manifest_files,
    read_manifests,
    write_manifest_documents,
    write_manifest_files,
    write_manifests,
)
from cuesheet.sources.subtitles import file_blocks, write_subtitle_table, write_subtitles


def test_find_and_describe_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, size in {"b.pdf": 131072, "sub/a.pdf": 10, "sub/deep/z.pdf": 1, "sub/empty.pdf": 0, "c.PDF": 5, "d.txt": 5}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    found = find_files(spark, str(tmp_path))
    assert [r.path.split(tmp_path.name + "/")[1] for r in found.collect()] == ["b.pdf", "sub/a.pdf", "sub/deep/z.pdf"]
    info = {r.name: (r.size, r.size_mb, r.suffix) for r in file_info(found).collect()}
    # 0.125 MB is a tie and goes to the even neighbour.
    assert info == {"b.pdf": (131072, 0.12, ".pdf"), "a.pdf": (10, 0.0, ".pdf"), "z.pdf": (1, 0.0, ".pdf")}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]

    asked = found.select("path").limit(1).unionByName(spark.createDataFrame([("none.pdf",)], "path string"))
    assert sorted(r.exists for r in lookup_files(asked, found).collect()) == [False, True]


def test_missing_folder_has_no_files(spark, tmp_path):
    assert find_files(spark, str(tmp_path / "none")).collect() == []
    assert find_files(spark, str(tmp_path)).collect() == []


def test_manifests_come_back_and_bad_ones_are_marked(spark, tmp_path):
    good = {
        "created": "2024-01-01T00:00:00",
        "project_name": "p",
        "source_pdf": "",
        "total_pages": 2,
        "total_audio_files": 1,
        "has_video": False,
        "voice_config": {"engine": "gtts", "speed": 1.0, "pitch": 0, "language": "en", "voice_id": None},
        "output_config": {"audio_format": "mp3", "video_resolution": [1920, 1080], "fps": 24},
        "file_list": {"audio_files": ["a.mp3"], "video_file": None},
    }
    many = good | {"total_audio_files": 10_000, "file_list": {"audio_files": [f"p{i}.mp3" for i in range(10_000)], "video_file": None}}
    lines = spark.createDataFrame(
        [(7, json.dumps(good)), (8, json.dumps(many)), (9, "{not json")], "doc_id int, manifest string"
    )
    folder = str(tmp_path / "m")
    write_manifests(lines, folder, "doc_id")
    back = {r.key: r for r in read_manifests(spark, folder).collect()}
    assert back["7"].project_name == "p"
    assert back["8"].file_list.audio_files == many["file_list"]["audio_files"]
    assert back["8"].total_audio_files == len(back["8"].file_list.audio_files)
    got = {r.corrupt is None: r for r in read_manifests(spark, folder).where("key is null or key <> '8'").collect()}
    assert got[True].file_list.audio_files == ["a.mp3"]
    assert (got[True].voice_config.engine, got[True].total_pages) == ("gtts", 2)
    assert got[False].project_name is None


def test_subtitle_files_on_disk(spark, tmp_path):
    block = "1\n00:00:00,000 --> 00:00:01,000\nHé\n\n"
    blocks = spark.createDataFrame([(1, 1, "b" + block), (1, 0, block), (2, 0, block)], "doc_id int, index int, block string")
    write_subtitles(blocks, str(tmp_path / "out"), "doc_id")
    for doc, text in ((1, block + "b" + block), (2, block)):
        (file,) = (tmp_path / "out" / f"doc_id={doc}").glob("*.txt")
        assert file.read_text(encoding="utf-8") == text


def test_subtitle_files_in_a_table(spark, tmp_path):
    files = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id int, srt string")
    write_subtitle_table(files, str(tmp_path / "t"), "doc_id", 4)
    assert len(list((tmp_path / "t").glob("bucket=*"))) == 4
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("doc_id", "srt").collect())) == sorted(map(tuple, files.collect()))
    write_subtitles(file_blocks(files, "doc_id", "srt"), str(tmp_path / "f"), "doc_id")
    assert len(list((tmp_path / "f").glob("doc_id=*/*.txt"))) == 50


def test_manifest_documents_of_any_size(spark, tmp_path):
    """Documents written line by line equal the manifests that are one value each."""
    key, many = "doc_id", 300_000
    audio = spark.range(many).select(F.lit(1).cast("bigint").alias(key), (F.col("id") * 2 + 1).cast("int").alias("page_number"), F.concat(F.lit('a "b"\\é'), F.col("id")).alias("path"))
    audio = audio.unionByName(spark.createDataFrame([(2, 1, "x.mp3"), (9, 1, "none")], audio.schema))
    pages = audio.where("doc_id < 3").select(key, "page_number")
    videos = spark.createDataFrame([(1, 'v".mp4')], "doc_id bigint, path string")
    wanted = J.with_defaults(spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "job_id bigint, doc_id bigint"), ["job_id", key]).withColumns(
        {"project_name": F.lit(None).cast("string"), "source_pdf": F.lit("s.pdf")}
    )
    args = (wanted, pages, audio, videos, key, "2024-01-01T00:00:00")
    folder = tmp_path / "m"
    write_manifest_files(A.manifest_blocks(*args), str(folder), "job_id")
    want = {r.job_id: json.loads(r.manifest) for r in A.manifests(*args).collect()}
    for job, manifest in want.items():
        (file,) = (folder / f"job_id={job}").glob("*.txt")
        assert json.loads(file.read_text(encoding="utf-8")) == manifest
    assert want[10]["total_audio_files"] == many == len(want[10]["file_list"]["audio_files"])
    got = read_manifest_files(spark, str(folder), "job_id").groupBy("job_id").agg(F.count("*").alias("n"), F.max("path").alias("p")).collect()
    assert sorted((r.job_id, r.n, r.p) for r in got) == [
        (job, len(m["file_list"]["audio_files"]), max(m["file_list"]["audio_files"])) for job, m in sorted(want.items()) if m["file_list"]["audio_files"]
    ]


def test_many_manifests_make_a_folder_per_task(spark, tmp_path):
    """Documents in the folders of few tasks, equal to the manifests that are one value each."""
    key, many = "doc_id", 2_000
    audio = spark.range(2 * many).select(F.shiftright("id", 1).alias(key), (F.col("id") % 2 + 1).cast("int").alias("page_number"), F.concat(F.lit('a "b"\\é'), "id").alias("path"))
    audio = audio.where("doc_id % 10 > 0")
    wanted = J.with_defaults(spark.range(many).select((F.col("id") + 7).alias("job_id"), F.col("id").alias(key)), ["job_id", key]).withColumns(
        {"project_name": F.lit(None).cast("string"), "source_pdf": F.lit("s.pdf")}
    )
    videos = spark.createDataFrame([(1, 'v".mp4')], "doc_id bigint, path string")
    args = (wanted, audio.select(key, "page_number"), audio, videos, key, "2024-01-01T00:00:00")
    write_manifest_documents(A.manifest_blocks(*args), str(tmp_path), "job_id")
    want = {r.job_id: json.loads(r.manifest) for r in A.manifests(*args).collect()}
    assert {int(p.stem): json.loads(p.read_text(encoding="utf-8")) for p in tmp_path.glob("part-*/*.json")} == want
    assert len(want) == many and len(list(tmp_path.iterdir())) <= 4
    read = read_manifest_documents(spark, str(tmp_path), "job_id")
    assert read.rdd.getNumPartitions() <= 4
    assert sorted((int(r.job_id), r.path) for r in read.collect()) == sorted((job, path) for job, m in want.items() for path in m["file_list"]["audio_files"])
