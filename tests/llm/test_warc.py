import hashlib
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import warc

PAGES = "page_id long, url string, html string, block string, warc_type string"


def test_records_on_disk(spark, tmp_path):
    rows = [
        (1, "http://a/1", '<title>A  b</title><a href="/x">x</a><p>caf&eacute; &#233;&#xe9;<p>two  words<script>no</script>', "", ""),
        (2, None, None, "", ""),
        (2, None, None, "", ""),
        (None, "http://a/3", "<p>long " + "x" * 300_000, "", ""),
    ]
    sources = warc.responses_from_pages(spark.createDataFrame(rows, PAGES))
    warc.write_warc(warc.derivatives(sources), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "w").glob("part-*")))
    blocks = {r.record_id: r.block for r in sources.collect()}
    found = []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block, raw = raw[:n], raw[n:]
        assert raw[:4] == b"\r\n\r\n"
        raw = raw[4:]
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        source = blocks[fields["WARC-Refers-To"].strip("<>")]
        payload = source.split("\r\n\r\n", 1)[1]
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
        found.append((fields, block.decode(), source))
    assert len(found) == 2 * len(rows)
    for fields, block, source in found:
        if fields["WARC-Type"] == "metadata":
            kept = re.findall(r"source-header: (.*)\r\n", block)
            assert kept == source.split("\r\n\r\n")[0].split("\r\n")
    texts = [b for f, b, _ in found if f["WARC-Type"] == "conversion"]
    assert "A b\nx\ncafé éé\ntwo words" in texts and texts.count("") == 2
    assert any("title: A b" in b and "outlink: /x L a/@href" in b for _, b, _ in found)


@pytest.mark.parametrize(
    "block,kinds",
    [
        ("HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nxx", {"metadata"}),
        ("HTTP/1.1 200 OK\r\n\r\n<p>x", {"metadata", "conversion"}),
        ("HTTP/1.1 200 OK", {"metadata", "conversion"}),
        (None, {"metadata", "conversion"}),
        ("HTTP/1.1 200 OK\r\nContent-type: Text/Plain; charset=x\r\n\r\na <b", {"metadata", "conversion"}),
    ],
)
def test_payload_types(spark, block, kinds):
    df = spark.createDataFrame(
        [("id", "response", None, None, block), ("q", "request", None, None, block)],
        "record_id string, warc_type string, target_uri string, warc_date string, block string",
    )
    out = warc.derivatives(df).collect()
    assert {r.warc_type for r in out} == kinds and {r.refers_to for r in out} == {"id"}
    assert len({r.record_id for r in out}) == len(kinds)


def test_empty(spark):
    df = warc.derivatives(warc.responses_from_pages(spark.createDataFrame([], PAGES)))
    assert df.where(F.lit(True)).count() == 0


def test_links_and_titles():
    page = """<a href='/x'>1</a><A class=b HREF=y>2</a><a title="a>b" href="/z?a=1&amp;b=2">3</a><a name=it's href=" /w ">4</a>
    <abbr href="no"><a hrefs="no"><a href><a
    href
    = "/v"><a x="href='no'" href=/u/><title>A &amp; <b>
    B</TITLE>"""
    assert warc.links_of(page) == ["/x", "y", "/z?a=1&b=2", "/w", "/v", "/u/"]
    assert warc.title_of(page) == "A & <b> B" and warc.title_of("<title>no end") == "" == warc.title_of("<title")


@pytest.mark.parametrize("unit", ["<p ", "<a ", "<a '", '<a "x', "<!-- ", "<! ", "<title", "<title>", "<script ", "<a href=", "&amp", "<a = ", " \n"])
def test_long_pages_take_linear_time(unit):
    page = unit * (2_000_000 // len(unit))
    start = time.monotonic()
    warc.plain_text(page), warc.title_of(page), warc.links_of(page)
    assert time.monotonic() - start < 8


def test_text_is_read_once(spark):
    df = warc.derivatives(warc.responses_from_pages(spark.createDataFrame([], PAGES)))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
