import pytest
from pyspark.sql import functions as F

from cuesheet.functions import timecode as C
from cuesheet.operators import timeline as T
from cuesheet.plans import scripts as S


@pytest.fixture
def rows(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def cues(df):
    return [(r["index"], r.start_time, r.end_time, r.text) for r in df.orderBy("doc_id", "index").collect()]


def test_timestamps(spark):
    times = [0.0, 1.001, 59.9999, 60.0, 3661.5, 360000.25]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double").orderBy("i")
    assert [r[0] for r in df.select(C.srt_timestamp(F.col("t"))).collect()] == [
        "00:00:00,000",
        "00:00:01,000",
        "00:00:59,999",
        "00:01:00,000",
        "01:01:01,500",
        "100:00:00,250",
    ]
    assert df.where("t = 3661.5").select(C.vtt_timestamp(F.col("t"))).first()[0] == "01:01:01.500"


def test_text_cues_clamp_then_scale(rows):
    # 40 characters in 40 s: one character a second. Sentences of 1, 2 and 33
    # characters last 1, 2 and, cut, 6 s; 9 s are stretched to 40.
    text = "a. bb. " + "c" * 33
    got = cues(T.text_cues(rows([(1, text, 40.0)], "doc_id int, text string, duration double"), ["doc_id"]))
    scale = 40.0 / 9.0
    assert [c[:3] for c in got] == [(1, 0.0, scale), (2, scale, 3 * scale), (3, 3 * scale, 9 * scale)]
    assert [c[3] for c in got] == ["a", "bb", "c" * 33]


def test_shortest_cue_before_scaling(rows):
    got = cues(T.text_cues(rows([(1, "a. b. c", 0.7)], "doc_id int, text string, duration double"), ["doc_id"]))
    assert [c[:3] for c in got] == [
        (1, 0.0, pytest.approx(0.7 / 3)),
        (2, pytest.approx(0.7 / 3), pytest.approx(1.4 / 3)),
        (3, pytest.approx(1.4 / 3), pytest.approx(0.7)),
    ]


def test_text_cues_without_text_or_time(rows):
    data = [(1, "", 5.0), (2, "a b", 0.0), (3, "a b", None), (4, "!? ", 3.0)]
    assert cues(T.text_cues(rows(data, "doc_id int, text string, duration double"), ["doc_id"])) == []


def test_real_texts_are_contiguous_and_end_with_the_text(spark):
    from cuesheet.plans import catalog
    from tests.conftest import SMALL

    texts = {r.doc_id: r for r in catalog.scripts(spark, SMALL).collect()}
    by_doc = {}
    for r in catalog.text_cues(spark, SMALL).orderBy("doc_id", "index").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, got in by_doc.items():
        assert [c["index"] for c in got] == list(range(1, len(got) + 1))
        assert got[0].start_time == 0.0
        assert all(a.end_time == b.start_time for a, b in zip(got, got[1:]))
        assert got[-1].end_time == pytest.approx(texts[doc].duration, rel=1e-6)
        assert all(len(line.removesuffix("...")) <= 60 for c in got for line in c.text.split("\n"))


PAGE = "doc_id int, page_number int, text string"
TIME = "doc_id int, page_number int, duration double"


def test_page_cues_overlap_and_blank_pages(rows):
    pages = rows([(1, 1, " one "), (1, 2, "  "), (1, 4, "two")], PAGE)
    times = rows([(1, 1, 0.5), (1, 2, 2.0), (1, 4, 0.0)], TIME)
    assert cues(T.page_cues(pages, times, "doc_id")) == [(1, 0.0, 1.0, "one"), (2, 2.5, 3.5, "two")]


def test_page_cues_share_time(rows):
    text = ". ".join(["x" * 100] * 3)
    got = cues(T.page_cues(rows([(1, 1, "a"), (1, 2, text)], PAGE), rows([(1, 1, 2.0), (1, 2, 9.0)], TIME), "doc_id"))
    assert [c[:3] for c in got] == [(1, 0.0, 2.0), (2, 2.0, 5.0), (3, 5.0, 8.0), (4, 8.0, 11.0)]


def test_unequal_counts_reject_the_whole_document(rows):
    pages = rows([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d"), (5, 1, "e"), (5, 2, "f")], PAGE)
    times = rows([(1, 1, 2.0), (2, 1, 2.0), (3, 1, 1.0), (3, 2, 1.0), (4, 1, 1.0), (5, 2, 1.0), (5, 3, 1.0)], TIME)
    assert {r.doc_id for r in T.page_cues(pages, times, "doc_id").collect()} == {2}
    mismatch = T.duration_mismatch(pages, times, "doc_id").orderBy("doc_id").collect()
    assert [tuple(r) for r in mismatch] == [
        (1, 2, 1, 1, "counts differ"),
        (3, 1, 2, 1, "counts differ"),
        (4, 0, 1, 1, "counts differ"),
        (5, 2, 2, 2, "page numbers differ"),
    ]
    heard = times.withColumn("exists", F.lit(True))
    assert {r.doc_id for r in T.segment_timeline(pages, heard, "doc_id").collect()} == {2}


def test_cue_stats(rows):
    data = [(1, 1, 0.0, 2.0, "ab"), (1, 2, 1.5, 2.5, "a\nbc"), (1, 3, 2.5, 4.0, "x...")]
    stats = T.cue_stats(
        rows(data, "doc_id int, index int, start_time double, end_time double, text string"),
        "doc_id",
        rows([(1,), (2,)], "doc_id int"),
    )
    assert [tuple(r) for r in stats.orderBy("doc_id").collect()] == [
        (1, 3, 4.0, 1.5, 10, pytest.approx(10 / 3), 1.0, 2.0),
        (2, 0, 0.0, 0.0, 0, 0.0, None, None),
    ]


def test_render_cues_drop_blank_text(rows):
    data = [(1, 0.0, 1.0, " \n"), (1, 1.0, 2.0, "x")]
    got = T.render_cues(rows(data, "doc_id int, start_time double, end_time double, text string"), ["doc_id"])
    assert got.columns == ["doc_id", "start", "end", "text"]
    assert [tuple(r) for r in got.collect()] == [(1, 1.0, 2.0, "x")]


def test_segments(rows):
    pages = rows([(1, 1, "a"), (1, 3, "b"), (1, 4, "c"), (2, 1, "d"), (2, 2, "e")], PAGE)
    audio = rows(
        [(1, 1, 2.0, True), (1, 3, 5.0, False), (1, 4, 1.5, True), (2, 1, 1.0, True)], TIME + ", exists boolean"
    )
    got = T.segment_timeline(pages, audio, "doc_id").orderBy("page_number").collect()
    # The missing file of page 3 takes no time; document 2 has too little audio.
    assert [tuple(r) for r in got] == [
        (1, 1, 1, 0.0, 2.0, "Page 1", "a"),
        (1, 4, 2, 2.0, 3.5, "Page 4", "c"),
    ]


def test_subtitle_files(rows):
    texts = rows([(1, "One. Two.", 4.0)], "doc_id int, text string, duration double")
    got = S.subtitle_files(texts, ["doc_id"]).first()
    assert got.srt == "1\n00:00:00,000 --> 00:00:01,714\nOne\n\n2\n00:00:01,714 --> 00:00:04,000\nTwo.\n\n"
    assert got.vtt == "WEBVTT\n\n00:00:00.000 --> 00:00:01.714\nOne\n\n00:00:01.714 --> 00:00:04.000\nTwo.\n\n"


def test_speech_seconds(spark):
    df = spark.createDataFrame([(100, 1.0), (100, 0.57), (10, 0.004)], "w int, s double")
    got = [tuple(r) for r in df.select(C.speech_rate(F.col("s")), C.speech_seconds(F.col("w"), F.col("s"))).collect()]
    assert got == [(200, 30.0), (113, 6000.0 / 113), (0, None)]


def test_measured_duration_comes_first(rows):
    texts = rows([("a b", 7.5), ("a b", None)], "text string, m double")
    got = S.with_duration(texts, F.lit(1.0), "m").collect()
    assert [r.duration for r in got] == [7.5, 0.6]
