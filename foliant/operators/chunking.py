"""Texts to chunks.

A document is one row and becomes an array of chunks in that row; nothing is
shuffled and documents are independent.  Python decides only where to cut: it
sees texts (or row lengths) and returns pieces (or row ranges).  Markers,
normalisation, header repetition, headings and counts are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliant import vocab
from foliant.functions import text
from foliant.operators.segments import page_parts, sheet_parts, table_header
from foliant.options import DEFAULTS, Options

#: UTF-8 bytes of text that a Python worker cuts at a time.
SLICE_BYTES = 4 << 20
_PIECES = pa.list_(pa.list_(pa.string()))
CHUNK = ["doc_id", "chunk_index", "page_number", "heading", "content", "character_count", "token_count"]


# ── where to cut ──────────────────────────────────────────────────────────────


def cut_point(window: str, limit: int) -> int:
    """Preferred end of a full window, searched in its second half only; -1 when there is none."""
    floor = limit // 2 + 1
    at = window.rfind("\n\n", floor)
    if at >= 0:
        return at
    at = max(window.rfind(stop, floor) for stop in (". ", "! ", "? "))
    if at >= 0:
        return at + 1
    at = window.rfind("\n", floor)
    return at if at >= 0 else window.rfind(" ", floor)


def spans(work: str, options: Options) -> Iterator[tuple[int, int]]:
    """Overlapping windows over a text as (start, end)."""
    start, size = 0, len(work)
    while start < size:
        end = min(start + options.chunk_chars, size)
        if end < size:
            cut = cut_point(work[start:end], options.chunk_chars)
            if cut > options.min_split_chars:
                end = start + cut
        yield start, end
        if end >= size:
            return
        start = end - options.overlap_chars if end - start > options.overlap_chars else end


def slide(segments: list[str], options: Options) -> list[list[str]]:
    """Pieces of each segment; a segment starts with the tail of the one before."""
    out, tail = [], None
    for segment in segments:
        work = segment if tail is None else f"{tail}\n\n{segment}"
        out.append([work[a:b].strip(vocab.WHITESPACE) for a, b in spans(work, options)])
        tail = work[-options.overlap_chars:].strip(vocab.WHITESPACE)
    return out


def slide_batch(batch: pa.ListArray, options: Options) -> Iterator[pa.ListArray]:
    """``slide`` of every row of a batch (arrays of segments), SLICE_BYTES of text at a time, one row at least."""
    sizes = np.zeros(len(batch), np.int64)
    np.add.at(sizes, pc.list_parent_indices(batch).to_numpy(), pc.fill_null(pc.binary_length(batch.flatten()), 0).to_numpy(zero_copy_only=False))
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield pa.array([slide(s, options) for s in batch.slice(start, end - start).to_pylist()], _PIECES)
        start = end


def pack(lengths: np.ndarray, header: int, limit: int) -> list[dict[str, int]]:
    """Consecutive row ranges whose lines and header stay within the limit, one row at least."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)
    ranges, start = [], 0
    while start < len(ends):
        used = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, used + limit - header, side="right")), start + 1)
        ranges.append({"start": start + 1, "n": stop - start})
        start = stop
    return ranges


# ── running text ──────────────────────────────────────────────────────────────


def chunk_text(docs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Sliding chunks of documents (doc_id, text) without sheet markers."""
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def pieces_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from slide_batch(batch, options)

    paged = text.has_page_marker("text")
    parts = F.transform(page_parts(F.col("text")), lambda p: F.struct(
        p["page_number"].alias("page_number"), text.normalize_text(p["content"], F.col("_paged")).alias("content")))
    segments = (docs.where(~text.is_blank("text")).select("doc_id", "text", paged.alias("_paged"))
                .select("doc_id", F.filter(parts, lambda p: F.length(p["content"]) > 0).alias("segments")))
    cut = segments.withColumn("_pieces", pieces_of(F.transform("segments", lambda s: s["content"])))
    # header and first piece once per segment: inside the function over the pieces they would be worked out for each
    marked = F.transform(F.arrays_zip("segments", "_pieces"), lambda z: F.struct(
        z["segments"]["page_number"].alias("page"), table_header(z["segments"]["content"]).alias("header"),
        _first_long(z["_pieces"], options).alias("first"), z["_pieces"].alias("pieces")))
    whole = F.flatten(F.transform(marked, lambda m: _with_headers(m["page"], m["header"], m["first"], m["pieces"], options)))
    return (cut.select("doc_id", F.posexplode(whole).alias("chunk_index", "c"))
            .select("doc_id", "chunk_index", "c.page_number", text.detect_heading("c.content").alias("heading"), "c.content",
                    F.length("c.content").alias("character_count"), text.token_estimate("c.content").alias("token_count")))


def _first_long(pieces: Column, options: Options) -> Column:
    """Place of the first piece that is long enough, 0 without one."""
    return F.array_position(F.transform(pieces, lambda p: F.length(p) >= options.min_chunk_chars), True)


def _with_headers(page: Column, header: Column, first: Column, pieces: Column, options: Options) -> Column:
    """Chunks of one segment: table continuations get the header, short pieces go."""
    def chunk(piece: Column, i: Column) -> Column:
        continued = ((first > 0) & (i + 1 > first) & header.isNotNull() & F.startswith(piece, F.lit("|"))
                     & ~F.startswith(piece, header))
        content = F.when(continued, F.concat(header, F.lit("\n"), piece)).otherwise(piece)
        return F.struct(page.alias("page_number"), content.alias("content"))
    return F.filter(F.transform(pieces, chunk), lambda c: F.length(c["content"]) >= options.min_chunk_chars)


# ── sheets ────────────────────────────────────────────────────────────────────


def _sheet_layout(part: Column) -> Column:
    """Header block and data rows of one sheet; null without a header."""
    rows = F.filter(F.transform(text.lines(part["content"]), text.strip_end), lambda x: F.startswith(x, F.lit("|")))
    rest = text.tail_of(rows)
    rule_at = F.array_position(F.transform(rest, lambda x: x.rlike(r"^[|\- :]+$")), True)
    header = F.get(rows, F.lit(0))
    rule = F.when(rule_at > 0, F.get(rest, (rule_at - 1).cast("int"))).otherwise(text.separator_from_header(header))
    block = F.concat(F.lit("--- Sheet: "), part["sheet_name"], F.lit(" ---\n"), header, F.lit("\n"), rule)
    data = F.filter(rest, lambda x, i: i + 1 != rule_at)
    return F.when(F.size(rows) > 0, F.struct(part["sheet_name"].alias("sheet_name"), block.alias("block"), data.alias("rows")))


def chunk_table_rows(docs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Chunks of whole rows under a repeated sheet, header and rule."""
    span = T.ArrayType(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])))

    @F.pandas_udf(span)
    def ranges_of(lengths: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([[pack(n, h, options.chunk_chars) for n, h in zip(ls, hs)] for ls, hs in zip(lengths, headers)])

    sheets = docs.select("doc_id", F.array_compact(F.transform(sheet_parts(F.col("text")), _sheet_layout)).alias("sheets"))
    cut = sheets.where(F.size("sheets") > 0).withColumn("_ranges", ranges_of(
        F.transform("sheets", lambda s: F.transform(s["rows"], F.length)), F.transform("sheets", lambda s: F.length(s["block"]))))

    def chunks(z: Column) -> Column:
        sheet = z["sheets"]
        packed = F.transform(z["_ranges"], lambda r: text.strip(F.concat(
            sheet["block"], F.lit("\n"), F.array_join(F.slice(sheet["rows"], r["start"], r["n"]), "\n"))))
        bare = F.array(sheet["block"])
        contents = F.when(F.size(sheet["rows"]) == 0, bare).otherwise(packed)
        return F.transform(F.filter(contents, lambda c: F.length(c) >= options.min_chunk_chars), lambda c: F.struct(
            sheet["sheet_name"].alias("heading"), c.alias("content")))
    whole = F.flatten(F.transform(F.arrays_zip("sheets", "_ranges"), chunks))
    return (cut.select("doc_id", F.posexplode(whole).alias("chunk_index", "c"))
            .select("doc_id", "chunk_index", F.lit(None).cast("int").alias("page_number"), "c.heading",
                    text.strip("c.content").alias("content"), F.length("c.content").alias("character_count"),
                    text.token_estimate("c.content").alias("token_count")))


def chunk_router(docs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Texts with a sheet marker by rows, all others by sliding windows."""
    tabular = F.contains("text", F.lit("--- Sheet:"))
    return (chunk_text(docs.where(~tabular), options).select(*CHUNK)
            .unionByName(chunk_table_rows(docs.where(tabular), options).select(*CHUNK)))
