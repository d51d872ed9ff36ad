"""Parquet tables of a data folder, and script tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that tell the rows of a table apart.
ROW_KEYS = {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",), "events": ("event_id",)}

# Character references of HTML and what they stand for.
REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&copy;": "\u00a9",
    "&middot;": "\u00b7",
    "&amp;": "&",
}


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The key of a table and the named columns."""
    keys = ROW_KEYS[name]
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*keys, *columns)


def html_paragraphs(html: Column) -> Column:
    """Paragraph texts of the article of a web page, in order, without tags.

    A paragraph ends at its closing tag, at the next paragraph, at a heading or
    where the article or the page ends. Headings are left out, text between
    paragraphs is a paragraph of its own, and blank ones are dropped.
    """
    article = F.regexp_extract(html, r"(?s)<article(?:\s[^>]*)?>(.*?)(?:</article>|\z)", 1)
    bare = F.regexp_replace(article, r"(?s)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>", "<p>")
    pieces = F.split(bare, r"</?p(?:\s[^>]*)?>")
    texts = F.transform(pieces, lambda p: _decoded(F.regexp_replace(p, r"<[^>]*>", " ")))
    return F.filter(texts, lambda t: t.rlike(r"\S"))


def _decoded(text: Column) -> Column:
    """The character references that pages use most; `&amp;` last, so that it
    makes no new one."""
    for reference, character in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
