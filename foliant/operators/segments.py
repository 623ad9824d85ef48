"""Splitting texts at page and sheet markers.  Everything stays inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant import vocab
from foliant.functions import text


def page_parts(c: Column) -> Column:
    """Segments of a text as array<struct<page_number, content>>; blank ones dropped.

    Without markers the whole text is one segment without a page; text before
    the first marker has none either.
    """
    numbers = F.regexp_extract_all(c, F.lit(vocab.PAGE_MARKER), F.lit(1))
    parts = F.transform(F.split(c, vocab.PAGE_MARKER, -1), lambda p, i: F.struct(
        F.get(numbers, i - 1).cast("int").alias("page_number"), text.strip(p).alias("content")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page_number"), c.alias("content")))
    return F.when(text.has_page_marker(c), F.filter(parts, lambda p: F.length(p["content"]) > 0)).otherwise(whole)


def page_segments(docs: DataFrame) -> DataFrame:
    return (docs.select("doc_id", F.posexplode(page_parts(F.col("text"))).alias("segment_no", "s"))
            .select("doc_id", "segment_no", "s.page_number", "s.content"))


def sheet_parts(c: Column) -> Column:
    """array<struct<sheet_name, content>> of the text after each sheet marker."""
    names = F.regexp_extract_all(c, F.lit(vocab.SHEET_MARKER), F.lit(1))
    parts = text.tail_of(F.split(c, vocab.SHEET_MARKER, -1))
    return F.zip_with(names, parts, lambda n, p: F.struct(text.strip(n).alias("sheet_name"), p.alias("content")))


def sheet_segments(docs: DataFrame) -> DataFrame:
    return (docs.select("doc_id", F.posexplode(sheet_parts(F.col("text"))).alias("segment_no", "s"))
            .select("doc_id", "segment_no", "s.sheet_name", "s.content"))


def table_header(c: Column) -> Column:
    """Header and rule of the first Markdown table that starts in the first eight lines, else null."""
    top = F.slice(F.filter(F.transform(text.lines(c), text.strip), lambda x: F.length(x) > 0), 1, 9)
    pairs = F.zip_with(F.slice(top, 1, 8), F.slice(top, 2, 8), lambda a, b: F.when(
        F.startswith(a, F.lit("|")) & b.rlike(r"^\|[|\- ]*$"), F.concat(a, F.lit("\n"), b)))
    return F.get(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0))


def table_header_block(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", table_header(F.col("text")).alias("header")).where(F.col("header").isNotNull())
