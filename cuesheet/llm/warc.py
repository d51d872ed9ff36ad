"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives one `metadata` record (its HTTP header lines, digests,
title and outlinks) and, if its payload is text, one `conversion` record with
the plain text. Both name the response in WARC-Refers-To and carry its target,
date and digests, so they can be traced without the source file.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from cuesheet.operators.blocks import explode_rows

_EOL = "\r\n"
_HIDDEN = [
    re.compile(rf"<{name}\b.*?(?:</{name}\s*>|\Z)", re.I | re.S)
    for name in ("script", "style", "noscript", "template")
]
# Every pattern takes the rest of the page where its end is missing: none reads a part twice.
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S)
_BLOCK = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|article|section|nav|header|footer"
    r"|aside|main|title|head|body|html|form|option|blockquote|pre|figure|figcaption)\b[^>]*(?:>|\Z)",
    re.I,
)
_TAG = re.compile(r"</?[a-z][^>]*(?:>|\Z)", re.I)
_SPACE = re.compile("[ \t\r\f\v ]+")
_LINES = re.compile(" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """The visible text of a page, one line per block, white space collapsed."""
    for hidden in _HIDDEN:
        page = hidden.sub(" ", page)
    page = _BLOCK.sub("\n", _COMMENT.sub(" ", page))
    page = html.unescape(_TAG.sub("", page))
    return _LINES.sub("\n", _SPACE.sub(" ", page)).strip(" \n")


_TITLE, _TITLE_END = re.compile("<title", re.I), re.compile("</title", re.I)
_ANCHOR = re.compile(r"<a(?=[\s/])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/=]*+([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_BLANKS = re.compile(r"\s+", re.A)


def title_of(page: str) -> str:
    """The first title, its references decoded and white space collapsed; empty
    if there is none or it does not end."""
    found = _TITLE.search(page)
    start = page.find(">", found.end()) if found else -1
    end = _TITLE_END.search(page, start) if start >= 0 else None
    return _BLANKS.sub(" ", html.unescape(page[start + 1 : end.start()])).strip(" ") if end else ""


def links_of(page: str) -> list[str]:
    """Targets of all anchors in order, however they are quoted, their
    references decoded, without white space."""
    out = []
    anchor = _ANCHOR.search(page)
    while anchor:
        end, value = anchor.end(), None
        while at := _ATTRIBUTE.match(page, end):
            end = at.end()
            if value is None and at[1].lower() == "href":
                value = next((v for v in at.groups()[1:] if v is not None), None)
        if value is not None:
            out.append(_BLANKS.sub("", html.unescape(value)))
        anchor = _ANCHOR.search(page, end)
    return out


@F.pandas_udf(StructType().add("text", "string").add("title", "string").add("links", ArrayType(StringType())))
def _read(pages: pd.Series, as_html: pd.Series) -> pd.DataFrame:
    """What both records say of a page; its plain text where `as_html` is true."""
    return pd.DataFrame(
        {
            "text": [plain_text(page) if wanted else None for page, wanted in zip(pages, as_html)],
            "title": [title_of(page) for page in pages],
            "links": [links_of(page) for page in pages],
        }
    )


def digest(data: Column) -> Column:
    """Labelled SHA-256 of a string's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(data, F.lit("")), 256))


def record_id(*parts: Column) -> Column:
    """A `urn:uuid` that depends on `parts` alone, so that a rerun gives the same."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    form = F.concat(
        cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4]
    )
    return F.concat(F.lit("urn:uuid:"), form)


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """WARC response records of a page table: record_id, warc_type, target_uri,
    warc_date, block. The date counts seconds by page_id; null html is empty."""
    body = F.coalesce("html", F.lit(""))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(_EOL + _EOL),
        body,
    )
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    return pages.select(
        record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        block.alias("block"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response: record_id, warc_type, refers_to, target_uri,
    warc_date, source_headers, source_block_digest, source_payload_digest,
    content_type, block, block_digest, content_length.

    Rows of another `warc_type` are passed over. A block without an empty line
    is all header and has an empty payload. A payload that is neither text nor
    without a declared type gives no conversion record. A null block is an
    empty one; repeated rows give repeated records; other columns are ignored.
    Texts of any length are read whole, in time that grows with their length.
    """
    block = F.coalesce("block", F.lit(""))
    split = F.instr(block, _EOL + _EOL)
    found = responses.where(F.col("warc_type") == "response").select(
        "record_id",
        "target_uri",
        "warc_date",
        F.when(split > 0, F.substring(block, F.lit(1), split - 1)).otherwise(block).alias("headers"),
        F.when(split > 0, block.substr(split + 4, F.length(block))).otherwise("").alias("payload"),
        digest(block).alias("source_block_digest"),
    )
    kind = F.lower(F.trim(F.regexp_extract("headers", r"(?im)^content-type:([^;\r\n]*)", 1)))
    lines = F.filter(F.split("headers", _EOL), lambda line: line != "")
    fields = F.concat(
        F.transform(lines, lambda line: F.concat(F.lit("source-header: "), line)),
        F.array(
            F.concat(F.lit("source-block-digest: "), F.col("source_block_digest")),
            F.concat(F.lit("source-payload-digest: "), F.col("source_payload_digest")),
            F.concat(F.lit("title: "), F.col("read.title")),
        ),
        F.transform("read.links", lambda link: F.concat(F.lit("outlink: "), link, F.lit(" L a/@href"))),
    )
    # Both records of a response come from one row, so that its text is read once.
    both = (
        found.withColumn("source_payload_digest", digest(F.col("payload")))
        .withColumn("convert", kind.isin("", "text/html", "text/plain", "application/xhtml+xml"))
        .withColumn("read", _read(F.col("payload"), F.col("convert") & (kind != "text/plain")))
        .withColumn("fields", F.concat(F.array_join(fields, _EOL), F.lit(_EOL)))
        .withColumn("text", F.when(kind == "text/plain", F.col("payload")).otherwise(F.col("read.text")))
    )
    made = F.filter(
        F.array(
            F.struct(
                F.lit("metadata").alias("warc_type"),
                F.lit("application/warc-fields").alias("content_type"),
                F.col("fields").alias("block"),
            ),
            F.when(
                F.col("convert"),
                F.struct(
                    F.lit("conversion").alias("warc_type"),
                    F.lit("text/plain; charset=utf-8").alias("content_type"),
                    F.col("text").alias("block"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    both = explode_rows(both, made, "made")
    content = F.col("made.block")
    return both.select(
        record_id(F.col("made.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("made.warc_type").alias("warc_type"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("headers").alias("source_headers"),
        "source_block_digest",
        "source_payload_digest",
        F.col("made.content_type").alias("content_type"),
        content.alias("block"),
        digest(content).alias("block_digest"),
        F.octet_length(content).cast("long").alias("content_length"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """`value`: every derivative as WARC/1.1 text, without its closing empty lines."""

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))  # null without a value

    head = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{_EOL}"),
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To-Date", F.col("warc_date")),
        field("WARC-Payload-Digest", F.col("source_payload_digest")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit(_EOL), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derivatives as WARC files, one per partition, through Spark's writer."""
    serialized(records).write.option("lineSep", _EOL + _EOL).text(path)
