import pytest
from pyspark.sql import functions as F

from cuesheet.operators import pages as P
from cuesheet.plans import scripts as S
from cuesheet.sources.tables import html_paragraphs, html_title


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


@pytest.fixture
def raw(spark):
    data = [(1, 1, "First page."), (1, 2, " 17 "), (1, 3, "Third--page"), (2, 1, "xy"), (3, 5, None), (4, 2, "Only one here.")]
    return spark.createDataFrame(data, "doc_id bigint, page_number int, text string")


def test_blank_pages_go_and_numbers_stay(raw):
    got = rows(P.page_rows(raw, "text", "pymupdf"), "doc_id", "page_number")
    assert got == [
        (1, 1, "First page.", "pymupdf"),
        (1, 3, "Third -  - page", "pymupdf"),
        (4, 2, "Only one here.", "pymupdf"),
    ]


def test_stats_of_documents_without_pages(raw):
    pages = P.page_rows(raw, "text", "pymupdf")
    got = rows(P.text_stats(pages, "doc_id", raw.select("doc_id").distinct()), "doc_id")
    assert got == [(1, 2, 26, 6, 3), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 1, 14, 3, 3)]
    assert rows(P.corpus_totals(pages), "total_pages") == [(3, 40)]
    assert rows(P.empty_documents(raw.select("doc_id").distinct(), pages, "doc_id"), "doc_id") == [(2,), (3,)]


def test_previews_and_report(raw):
    pages = P.page_rows(raw, "text", "pymupdf")
    docs = raw.select("doc_id").distinct()
    assert rows(P.document_preview(pages, "doc_id", docs, 12), "doc_id") == [
        (1, "First page. ..."),
        (2, P.NO_TEXT),
        (3, P.NO_TEXT),
        (4, "Only one her..."),
    ]
    assert rows(P.first_page_preview(pages, "doc_id", 20), "doc_id") == [(1, "First page."), (4, "Only one here.")]
    assert rows(S.text_report(pages, "doc_id", docs), "doc_id")[0] == (1, 2, "26", "6", 3, "First page.", "0.0")


def test_fallback_is_for_the_whole_document(spark):
    schema = "doc_id bigint, page_number int, text string"
    one = spark.createDataFrame([(1, 1, "a"), (2, 4, "b")], schema)
    two = spark.createDataFrame([(1, 1, "A"), (1, 2, "AA"), (3, 1, "C")], schema)
    got = rows(P.extract_fallback(one, two, "doc_id"), "doc_id", "page_number")
    assert got == [(1, 1, "a"), (2, 4, "b"), (3, 1, "C")]
    assert P.extract_fallback(one, two, "doc_id", "pdfplumber").count() == 3
    assert P.extract_fallback(one, two, "doc_id", "pymupdf").count() == 2
    with pytest.raises(ValueError):
        P.extract_fallback(one, two, "doc_id", "ocr")


def test_elements_become_numbered_pages(spark):
    html = "<title>T t t</title><p>out</p><article><p>One <b>bold</b></p>\n<p> </p><p>Three</p></article>"
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "doc_id int, html string")
    got = P.pages_of_elements(df, html_paragraphs(F.col("html")), "x").select("doc_id", "page_number", "text")
    assert rows(got, "page_number") == [(1, 1, "One bold"), (1, 2, "Three")]
    assert [r[0] for r in df.select(html_title(F.col("html"))).collect()] == ["T t t", ""]


def test_html_paragraphs_lose_no_text(spark):
    from pyspark.sql import functions as F

    from cuesheet.sources.tables import html_paragraphs

    page = (
        "<nav>menu</nav><article class=x><h1>Title</h1>loose<p>one<b> bold</b><p>two &amp; &lt;b&gt;</p>after"
        "<h2>Part</h2><p id=z> <p>three<br>lines</p></article><p>outside"
    )
    df = spark.createDataFrame([(page,), ("<article><p>cut o",), ("none",), (None,)], "html string")
    got = [r[0] for r in df.select(html_paragraphs(F.col("html"))).collect()]
    assert [[" ".join(x.split()) for x in g] if g else g for g in got] == [
        ["loose", "one bold", "two & <b>", "after", "three lines"],
        ["cut o"],
        [],
        None,
    ]
