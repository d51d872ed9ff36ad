"""Page rows: (document, page_number, text, extraction_method)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.text import clean_text, preview, survives_cleaning, word_count
from cuesheet.operators.blocks import document_facts, explode_rows

# Names of the extraction methods, and the message for no text.
PRIMARY_METHOD = "pymupdf"
SECONDARY_METHOD = "pdfplumber"
NO_TEXT = "No text could be extracted from this PDF."


def page_rows(rows: DataFrame, text: str, method: str) -> DataFrame:
    """Clean the text of numbered pages and drop blank ones.

    The others keep their numbers. The filter reads the raw text, so blank
    pages are gone before any cleaning is done.
    """
    return rows.where(survives_cleaning(F.col(text))).withColumns(
        {text: clean_text(F.col(text)), "extraction_method": F.lit(method)}
    )


def pages_of_elements(rows: DataFrame, elements: Column, method: str) -> DataFrame:
    """Page rows from an array of page texts, numbered from 1."""
    numbered = explode_rows(rows, elements, "text", "__at").withColumn(
        "page_number", F.col("__at") + 1
    )
    return page_rows(numbered.drop("__at"), "text", method)


def extract_fallback(primary: DataFrame, secondary: DataFrame, key: str, method: str = "auto") -> DataFrame:
    """Pages of the first extractor, or of the second for documents the first
    found no page in. A named method takes its own pages only."""
    if method == PRIMARY_METHOD:
        return primary
    if method == SECONDARY_METHOD:
        return secondary
    if method != "auto":
        raise ValueError(f"unknown extraction method: {method}")
    covered = primary.select(key).distinct()
    missing = document_facts(secondary, key, "page_number", {}, covered, "left_anti")
    return primary.unionByName(missing)


def empty_documents(documents: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Documents without any page; these produce nothing."""
    return documents.join(pages.select(key).distinct(), key, "left_anti")


def text_stats(pages: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """Page, character and word counts of every document, zeros without pages."""
    counts = pages.groupBy(key).agg(
        F.count("*").alias("total_pages"),
        F.sum(F.length("text").cast("bigint")).alias("total_characters"),
        F.sum(word_count(F.col("text"))).alias("total_words"),
    )
    zero = F.lit(0).cast("bigint")
    found = documents.select(key).join(counts, key, "left")
    return found.select(
        key,
        *[F.coalesce(c, zero).alias(c) for c in ("total_pages", "total_characters", "total_words")],
        F.coalesce(F.expr("total_words div total_pages"), zero).alias("average_words_per_page"),
    )


def corpus_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count("*").alias("total_pages"),
        F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("total_characters"),
    )


def assemble(pages: DataFrame, key: str) -> DataFrame:
    """Text of a document: its pages in order, joined by a space.

    One string is what a caller of it wants; what can do without it, such as
    the cues of a document, never asks for it.
    """
    joined = F.expr("listagg(text, ' ') within group (order by page_number)")
    return pages.groupBy(key).agg(joined.alias("text"))


def document_preview(pages: DataFrame, key: str, documents: DataFrame, max_chars: int = 500) -> DataFrame:
    """First characters of every document's text, or a message without pages.

    Blank pages add nothing and are left out. Each other page adds two
    characters or more with the space that follows it, so the first
    `max_chars // 2 + 1` of them decide, and of each no more than could be shown. Spark ranks and cuts within each input split, before the shuffle.
    """
    pages = pages.where(F.col("text").rlike(r"\S"))
    pages = pages.select(key, "page_number", F.substring("text", 1, max_chars + 1).alias("text"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("page_number"))
    first = pages.withColumn("__rank", rank).where(F.col("__rank") <= max_chars // 2 + 1)
    joined = F.expr("listagg(text, ' ') within group (order by page_number)")
    texts = first.groupBy(key).agg(joined.alias("__text"))
    shown = documents.select(key).join(texts, key, "left")
    return shown.select(
        key, F.coalesce(preview(F.col("__text"), max_chars), F.lit(NO_TEXT)).alias("preview")
    )


def first_page_preview(pages: DataFrame, key: str, max_chars: int = 500) -> DataFrame:
    """Beginning of the first page that is left in each document."""
    shown = preview(F.col("text"), max_chars)
    return pages.groupBy(key).agg(F.min_by(shown, "page_number").alias("preview"))
