import json

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import names as N
from cuesheet.operators import artifacts as A
from cuesheet.operators import jobs as J


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


@pytest.fixture
def jobs(spark):
    def make(*overrides):
        fields = sorted({k for o in overrides for k in o})
        kinds = {**{k: v[0] for k, v in J.DEFAULTS.items()}, "doc_id": "bigint", "input_path": "string", "background": "string"}
        schema = ", ".join(f"{f} {kinds.get(f, 'string')}" for f in ["job_id", *fields]).replace("job_id string", "job_id int")
        data = [(i, *[o.get(f) for f in fields]) for i, o in enumerate(overrides)]
        df = spark.createDataFrame(data, schema)
        return J.with_defaults(df, ["job_id", *[f for f in fields if f in ("doc_id", "input_path", "background")]])

    return make


def test_defaults_and_unknown_settings(jobs):
    got = jobs({"speed": 1.5, "colour": "red"}, {"engine": "gtts"}).orderBy("job_id").collect()
    assert "colour" not in got[0].asDict()
    assert (got[0].speed, got[0].engine, got[0].audio_format, got[0].fps) == (1.5, "pyttsx3", "mp3", 24)
    assert (got[1].speed, got[1].engine, got[1].voice_id, got[1].subtitles) == (1.0, "gtts", None, False)


def test_config_snapshot(jobs):
    snapshot = json.loads(jobs({"pitch": 3}).select(J.config_snapshot()).first()[0])
    assert snapshot["voice"] == {"engine": "pyttsx3", "speed": 1.0, "pitch": 3, "language": "en", "voice_id": None}
    assert snapshot["output"]["video_resolution"] == [1920, 1080]
    assert snapshot["paths"]["temp_dir"] == "temp"


def test_resolution(apply):
    texts = ["1920x1080", " 12 x 7", "+5x1_0", "0x480", "-1x5", "wide", "1x2x3", "1920X1080", "x", "1.5x2", "1_x2"]
    got = apply(J.resolution, texts)
    assert [tuple(r) if r else None for r in got] == [(1920, 1080), (12, 7), (5, 10)] + [None] * 8


def test_first_broken_rule_is_the_reason(spark, jobs):
    good = {"input_path": "a.PDF"}
    cases = [
        (good, None),
        ({**good, "engine": "x", "speed": 9.0}, "unknown engine"),
        ({**good, "output_type": "x"}, "unknown output type"),
        ({**good, "audio_format": "ogg"}, "unknown audio format"),
        ({**good, "extraction_method": "ocr"}, "unknown extraction method"),
        ({"input_path": "gone.pdf", "pitch": 99}, "input not found"),
        ({"input_path": "b.txt"}, "input is no script"),
        ({**good, "speed": 0.49}, "speed out of range"),
        ({**good, "speed": 0.5, "pitch": -50}, None),
        ({**good, "speed": 2.0, "pitch": 51}, "pitch out of range"),
        ({**good, "resolution": "0x1"}, "invalid resolution"),
        ({**good, "background": "gone.png"}, "background not found"),
        ({**good, "background": "bg.png"}, None),
        ({**good, "background": ""}, None),
    ]
    existing = spark.createDataFrame([("a.PDF",), ("b.txt",), ("bg.png",)], "path string")
    wanted = jobs(*[{"background": None, **c} for c, _ in cases])
    got = J.validate(wanted, existing).orderBy("job_id").collect()
    assert [r.reject_reason for r in got] == [want for _, want in cases]


def test_format_gate(spark):
    df = spark.createDataFrame([("a.pdf",), ("b.Pdf",), ("c.txt",), ("d",), (".pdf",)], "path string")
    assert [r.is_valid for r in J.format_gate(df).collect()] == [True, True, False, False, False]


ENGINES = "name string, ordinal int, available boolean"


def test_engine_routing(spark, jobs):
    wanted = jobs(*[{"engine": e} for e in (*J.ENGINES, "other")])
    some = spark.createDataFrame([("pyttsx3", 0, False), ("gtts", 1, True), ("elevenlabs", 2, True)], ENGINES)
    none = some.withColumn("available", F.lit(False))
    pick = ("job_id", "routed_engine", "routing")
    assert rows(J.route_engines(wanted, some).select(*pick), "job_id") == [
        (0, "gtts", "fallback"),
        (1, "gtts", "requested"),
        (2, "elevenlabs", "requested"),
        (3, None, "unknown engine"),
    ]
    assert [r[1:] for r in rows(J.route_engines(wanted, none).select(*pick), "job_id")] == [
        (None, "none available")
    ] * 3 + [(None, "unknown engine")]


def test_voice_match(spark, jobs):
    voices = spark.createDataFrame(
        [
            ("com.Voice.Anna", 1, "pyttsx3"),
            ("com.voice.ANNABEL", 0, "pyttsx3"),
            ("Zed", 2, "pyttsx3"),
            ("com.voice.anna.zeda", -1, "gtts"),
        ],
        "id string, ordinal int, engine string",
    )
    wanted = jobs(*[{"voice_id": v} for v in ("anna", "ANNA.", "voice.anna", "zed", "Zeda", "", None, "com.voice.anna")])
    got = rows(J.match_voices(wanted, voices).select("job_id", "matched_voice"), "job_id")
    assert [m for _, m in got] == [
        "com.voice.ANNABEL",
        None,
        "com.voice.ANNABEL",
        "Zed",
        None,
        None,
        None,
        "com.voice.ANNABEL",
    ]


PAGES = "doc_id bigint, page_number int, text string"


def test_requests(spark, jobs):
    pages = spark.createDataFrame([(1, 1, "a b"), (1, 2, " "), (1, 12, "c" * 6000), (2, 1, "no job")], PAGES)
    settings = jobs({"doc_id": 1, "speed": 0.57, "audio_format": "wav", "separate_pages": True}).withColumn(
        "routed_engine", F.lit("gtts")
    )
    prefix = F.concat(F.lit("d"), F.col("doc_id"))
    together = settings.withColumn("separate_pages", F.lit(False))
    assert rows(J.combined_requests(pages, together, "doc_id", prefix).drop("job_id"), "filename") == [
        (1, None, "d1_complete.wav", "gtts", 113, True, 6006, 1)
    ]
    assert J.combined_requests(pages, settings, "doc_id", prefix).isEmpty()
    assert J.page_requests(pages, together, "doc_id", prefix).isEmpty()
    for none in (together.withColumn("output_type", F.lit("video")), together.withColumn("routed_engine", F.lit(None).cast("string"))):
        assert J.combined_requests(pages, none, "doc_id", prefix).isEmpty()
    assert rows(J.page_requests(pages, settings, "doc_id", prefix).drop("job_id"), "page_number") == [
        (1, 1, "d1_001.mp3", "gtts", 113, True, 3, 1),
        (1, 12, "d1_012.mp3", "gtts", 113, True, 6000, 1),
    ]
    texts = spark.createDataFrame([(1, "a" * 3000 + ". " + "b" * 3000), (1, " ")], "doc_id bigint, text string")
    assert rows(J.document_requests(texts, settings, "doc_id", prefix).drop("job_id"), "filename") == [
        (1, None, "d1_complete.wav", "gtts", 113, True, 6002, 2)
    ]


def test_outcomes(spark):
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, ""), (1, 3, ""), (2, 1, "")], PAGES)
    done = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "doc_id bigint, page_number int, ok boolean")
    assert rows(J.synthesis_outcomes(pages, done, "doc_id"), "doc_id") == [
        (1, 3, 1, 2, 2, True),
        (2, 1, 0, 1, 1, False),
    ]
    assert rows(J.failed_pages(pages, done, "doc_id"), "doc_id", "page_number") == [(1, 2), (1, 3), (2, 1)]


def test_artifact_plan(spark, jobs):
    pages = spark.createDataFrame([(d, p, "") for d in (1, 2, 3, 4) for p in (1, 3)], PAGES)
    settings = jobs(
        {"doc_id": 1, "output_type": "video", "subtitles": True},
        {"doc_id": 2, "output_type": "both", "subtitles": True, "separate_pages": True},
        {"doc_id": 3, "output_type": "audio", "subtitles": True, "audio_format": "wav"},
        {"doc_id": 4, "output_type": "both"},
        {"doc_id": 5, "output_type": "both"},
    )
    prefix = F.concat(F.lit("d"), F.col("doc_id"))
    got = rows(A.artifact_plan(settings, pages, "doc_id", prefix).drop("job_id"), "doc_id", "filename")
    assert got == [
        (2, "audio", 1, "d2_001.mp3"),
        (2, "audio", 3, "d2_003.mp3"),
        (2, "video", None, "d2_complete.mp4"),
        (2, "srt", 1, "d2_page_001.srt"),
        (2, "srt", 3, "d2_page_002.srt"),
        (3, "srt", None, "d3_complete.srt"),
        (3, "audio", None, "d3_complete.wav"),
        (4, "audio", None, "d4_complete.mp3"),
        (4, "video", None, "d4_complete.mp4"),
    ]


def test_two_jobs_on_one_document_keep_its_numbers(spark, jobs):
    pages = spark.createDataFrame([(1, p, "text") for p in (2, 4)], PAGES)
    settings = jobs(
        {"doc_id": 1, "subtitles": True, "separate_pages": True}, {"doc_id": 1, "subtitles": True, "separate_pages": False}
    ).withColumn("routed_engine", F.lit("gtts"))
    got = rows(A.artifact_plan(settings, pages, "doc_id", F.lit("x")).where("kind = 'srt'"), "job_id", "filename")
    assert got == [
        (0, 1, "srt", 2, "x_page_001.srt"),
        (0, 1, "srt", 4, "x_page_002.srt"),
        (1, 1, "srt", None, "x_complete.srt"),
    ]
    asked = J.page_requests(pages, settings, "doc_id", F.lit("x")).unionByName(
        J.combined_requests(pages, settings, "doc_id", F.lit("x"))
    )
    assert [(r.job_id, r.filename) for r in asked.orderBy("job_id", "filename").collect()] == [
        (0, "x_002.mp3"),
        (0, "x_004.mp3"),
        (1, "x_complete.mp3"),
    ]


def test_layout_counts_missing_files(spark):
    audio = spark.createDataFrame(
        [(1, 1, "x/a.mp3", True), (1, 2, "x/b.mp3", False), (1, 5, "x/c.wav", True)],
        "doc_id bigint, page_number int, path string, exists boolean",
    )
    base, stamp = F.lit("talk"), F.lit("T")
    assert rows(A.output_layout(audio, "doc_id", base, stamp), "target") == [
        (1, "x/a.mp3", "talk_T/audio/talk_page_001.mp3"),
        (1, "x/c.wav", "talk_T/audio/talk_page_003.wav"),
    ]
    video = spark.createDataFrame([(1, "v.mp4", True), (2, "w.mp4", False)], "doc_id bigint, path string, exists boolean")
    assert rows(A.video_layout(video, "doc_id", base, stamp), "target") == [(1, "v.mp4", "talk_T/video/talk_complete.mp4")]


def test_names(apply):
    paths = ["a/b.tar.gz", "b", ".hidden", "x.", "a.b/c", "é.PDF"]
    assert apply(N.suffix, paths) == [".gz", "", "", "", "", ".PDF"]
    assert apply(N.stem, paths) == ["b.tar", "b", ".hidden", "x.", "c", "é"]
    assert apply(N.dotted, ["mp3", ".mp3", ""]) == [".mp3", ".mp3", ""]
