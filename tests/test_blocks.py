"""A document with most of all rows, over many blocks, against a plain loop."""

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import artifacts as A
from cuesheet.operators import pages as P
from cuesheet.operators import render as R
from cuesheet.operators import timeline as T
from cuesheet.sources.subtitles import write_subtitles
from cuesheet.operators.blocks import document_facts

HOT_PAGES = 13000


@pytest.fixture(scope="module")
def hot(spark):
    """Document 1 has 13,000 page numbers with gaps, the others a few."""
    big = spark.range(1, HOT_PAGES + 1).where("id % 10 != 3").select(
        F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("page_number")
    )
    small = spark.range(2, 40).select(
        F.col("id").alias("doc_id"), F.explode(F.expr("sequence(1, cast(id % 4 as int) + 1)")).alias("page_number")
    )
    n = F.col("page_number")
    text = F.concat(
        F.lit("Page "),
        n.cast("string"),
        F.when(n % 3 == 0, F.lit(" ends. It goes on! Then")).when(n % 3 == 1, F.lit(" stops here.")).otherwise(F.lit(" runs")),
    )
    rows = big.unionByName(small).withColumn("text", text).withColumn("duration", (n % 7) / F.lit(4.0))
    return rows.repartition(4).cache()


def by_document(df, *columns):
    out = {}
    for row in sorted(df.select("doc_id", *columns).collect()):
        out.setdefault(row.doc_id, []).append(row[1:])
    return out


def test_running_sums_and_totals(hot):
    facts = document_facts(hot, "doc_id", "page_number", {"time": F.col("duration"), "n": F.lit(1)})
    assert facts.count() == hot.count()
    for rows in by_document(facts, "page_number", "duration", "time_before", "n_before", "time_total", "n_total").values():
        time = 0.0
        for i, (_, duration, before, at, total, n) in enumerate(rows):
            assert (before, at, total, n) == (time, i, sum(r[1] for r in rows), len(rows))
            time += duration


def test_sparse_long_ordinals(spark):
    ids = [0, 1, 4095, 4096, 2**32 - 1, 2**32, 2**45, 2**45 + 5, 2**62]
    df = spark.createDataFrame([("a", i) for i in ids] + [("b", 7)], "k string, o bigint")
    facts = document_facts(df, "k", "o", {"n": F.lit(1)}, sparse=True)
    assert [(r.o, r.n_before, r.n_total) for r in facts.where("k = 'a'").orderBy("o").collect()] == [
        (o, i, len(ids)) for i, o in enumerate(ids)
    ]


def test_attach_kinds(hot, spark):
    marks = spark.createDataFrame([(1, "x"), (3, "y")], "doc_id bigint, mark string")
    everything = hot.count()
    hot_rows = hot.where("doc_id in (1, 3)").count()
    args = (hot, "doc_id", "page_number", {})
    assert document_facts(*args, marks, "inner").count() == hot_rows
    assert document_facts(*args, marks, "left").count() == everything
    kept = document_facts(*args, marks.select("doc_id"), "left_anti")
    assert kept.count() == everything - hot_rows
    assert kept.columns == hot.columns


def test_rows_of_one_document_do_not_meet_in_one_task(hot):
    facts = document_facts(hot, "doc_id", "page_number", {"n": F.lit(1)})
    plan = facts._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning(doc_id" in line.replace("Exchange ", ""):
            wide = "text" in line
            assert not wide
    assert "__block1" in plan
    keyed = [l for l in plan.splitlines() if "Window [" in l and "page_number" in l]
    assert keyed and all("__block1" in l for l in keyed)


def expected_page_cues(rows, chunks_of):
    """Cue times of one document from its pages in order."""
    time, cues = 0.0, []
    for number, text, duration in rows:
        chunks = chunks_of[text, duration]
        share = duration / len(chunks)
        for i, chunk in enumerate(chunks):
            start = time + i * share
            stop = min(start + share, time + duration)
            cues.append((len(cues) + 1, start, stop if stop - start >= 1 else start + 1, chunk))
        time += duration
    return cues


def test_page_cues_of_a_hot_document(hot):
    from cuesheet.functions.segments import cue_chunks, wrap_cue

    stretched = hot.withColumn("duration", F.col("duration") * 8)
    chunk = F.transform(cue_chunks(F.col("text"), F.col("duration")), wrap_cue)
    chunks_of = {(r.text, r.duration): r.c for r in stretched.select("text", "duration", chunk.alias("c")).collect()}
    got = by_document(T.page_cues(stretched, stretched, "doc_id"), "index", "start_time", "end_time", "text")
    pages = by_document(stretched, "page_number", "text", "duration")
    assert got.keys() == pages.keys()
    for doc, rows in pages.items():
        for cue, want in zip(got[doc], expected_page_cues(rows, chunks_of), strict=True):
            assert (cue[0], cue[3]) == (want[0], want[3])
            assert cue[1:3] == pytest.approx(want[1:3], abs=1e-6)


def test_document_cues_equal_cues_of_the_joined_text(hot, spark):
    pages = by_document(hot, "page_number", "text", "duration")
    joined = spark.createDataFrame(
        [(d, " ".join(r[1] for r in rows), sum(r[2] for r in rows)) for d, rows in pages.items()],
        "doc_id bigint, text string, duration double",
    )
    want = by_document(T.text_cues(joined, ["doc_id"]), "index", "start_time", "end_time", "text")
    got = by_document(T.document_cues(hot, hot, "doc_id"), "index", "start_time", "end_time", "text")
    assert got.keys() == want.keys()
    for doc in want:
        assert len(got[doc]) == len(want[doc])
        for a, b in zip(got[doc], want[doc]):
            assert (a[0], a[3]) == (b[0], b[3])
            assert a[1:3] == pytest.approx(b[1:3], rel=1e-9, abs=1e-6)


def test_assembly_is_the_whole_text(hot):
    texts = dict(P.assemble(hot, "doc_id").collect())
    for doc, rows in by_document(hot, "page_number", "text").items():
        assert texts[doc] == " ".join(r[1] for r in rows)


def test_preview_of_a_hot_document(hot):
    shown = {r.doc_id: r.preview for r in P.document_preview(hot, "doc_id", hot.select("doc_id").distinct()).collect()}
    for doc, rows in by_document(hot, "page_number", "text").items():
        whole = " ".join(r[1] for r in rows)
        assert shown[doc] == (whole if len(whole) <= 500 else whole[:500] + "...")


def test_subtitle_files_of_a_hot_document_are_whole(hot, tmp_path):
    cues = T.page_cues(hot, hot, "doc_id").cache()
    assert cues.where("doc_id = 1").count() > 10_000
    for render, kind in ((R.srt_blocks, "srt"), (R.vtt_blocks, "vtt")):
        folder = tmp_path / kind
        write_subtitles(render(cues, ["doc_id"]), str(folder), "doc_id")
        for doc, rows in by_document(cues, "index", "start_time", "end_time", "text").items():
            (file,) = (folder / f"doc_id={doc}").glob("*.txt")
            text = file.read_text(encoding="utf-8")
            head, *blocks = text.split("\n\n")[:-1] if kind == "vtt" else ["", *text.split("\n\n")[:-1]]
            assert head == ("WEBVTT" if kind == "vtt" else "") and len(blocks) == len(rows)
            for row, block in zip(rows, blocks):
                lines = block.split("\n")
                if kind == "srt":
                    assert lines.pop(0) == str(row[0])
                assert " --> " in lines[0] and "\n".join(lines[1:]) == row[3]


def test_file_lists_of_a_hot_document(hot):
    files = hot.withColumn("path", F.concat(F.lit("f"), F.col("page_number")))
    plan = by_document(A.concat_plan(files, "doc_id"), "position", "action", "n_files", "path")
    for doc, rows in by_document(files, "page_number", "path").items():
        assert [p[0] for p in plan[doc]] == list(range(1, len(rows) + 1))
        assert [p[3] for p in plan[doc]] == [r[1] for r in rows]
        assert {p[1:3] for p in plan[doc]} == {("copy" if len(rows) == 1 else "concat", len(rows))}


def test_unique_names_of_a_hot_name(spark):
    asked = spark.range(9000).select(
        (F.col("id") * 1000003).alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 40)).alias("base"),
        F.lit("mp3").alias("extension"),
    )
    held = [("hot", "mp3", c) for c in (0, 1, 2, 5, 2500, 2501, 2998, 9999)] + [("n1", ".mp3", 1), ("n2", "wav", 0)]
    taken = spark.createDataFrame(held, "base string, extension string, counter int")
    got = {r.id: r.filename for r in A.unique_names(asked, taken, F.lit("T")).collect()}
    used, want = {}, {}
    for row in asked.orderBy("id").collect():
        blocked = used.setdefault(row.base, {c for b, e, c in held if b == row.base and e.strip(".") == "mp3"})
        counter = next(c for c in range(10**6) if c not in blocked)
        blocked.add(counter)
        want[row.id] = f"{row.base}_T{f'_{counter}' if counter else ''}.mp3"
    assert got == want
