"""Page and sheet layout as relational jobs over words and cells that a reader supplies.

words  doc_id, page, word, left_x, right_x, bottom
cells  doc_id, sheet_no, sheet_name, row_no, col_no, value        merged  doc_id, sheet_no, r1, c1, r2, c2
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foliant import vocab
from foliant.functions import text
from foliant.options import DEFAULTS
from foliant.plans.ranking import join_text, text_parts
from foliant.session import cut_lineage

LINE_TOLERANCE = 3.0
COLUMN_GAP = 20.0
#: Words whose pages one task puts into lines.
TASK_WORDS = 1 << 20
_SHEET = ["doc_id", "sheet_no"]


# ── pages ─────────────────────────────────────────────────────────────────────


def _by_page(words: DataFrame) -> DataFrame:
    """Words dealt to tasks by page, as many tasks as words ask for: every step up to the page's lines stays inside its task."""
    return words.repartition(int(words.count() // TASK_WORDS + 1), "doc_id", "page")


def _lines(heights: DataFrame, carried: list[str]) -> DataFrame:
    """Adds the line of every distinct height of a page, dealt by page; ``carried`` columns stay with their height.

    Words join the line whose first word is less than three units away.  Only
    distinct heights matter, and a gap of three or more always starts a line, so
    the greedy choice is confined to short runs of close heights.
    """
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("bottom").desc())
    apart = F.coalesce((F.lag("bottom").over(w) - F.col("bottom")) >= LINE_TOLERANCE, F.lit(True))
    runs = (heights.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w))
            .groupBy("doc_id", "page", "_run").agg(F.sort_array(F.collect_list(F.struct("bottom", *carried)), asc=False).alias("r"))
            .withColumn("h", F.col("r.bottom")))

    def anchor(done, height):
        last = F.element_at(done, -1)
        return F.array_append(done, F.when((F.size(done) > 0) & (last - height < LINE_TOLERANCE), last).otherwise(height))
    anchors = F.aggregate(text.tail_of(F.col("h")), F.slice(F.col("h"), 1, 1), anchor)
    lines = (runs.select("doc_id", "page", F.explode(F.arrays_zip("r", anchors.alias("anchor"))).alias("z"))
             .select("doc_id", "page", "z.r.bottom", *[F.col(f"z.r.{c}") for c in carried], "z.anchor"))
    order = Window.partitionBy("doc_id", "page").orderBy(F.col("anchor").desc())
    return lines.select("doc_id", "page", "bottom", *carried, F.dense_rank().over(order).alias("line_no"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Line of every height on a page: doc_id, page, bottom, line_no."""
    return _lines(_by_page(words.select("doc_id", "page", "bottom")).distinct(), [])


def line_render(words: DataFrame) -> DataFrame:
    """Text of each line, wide gaps shown as column bars.

    A page's words move once: they stay with their height while its line is found.
    """
    known = words.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("bottom").isNotNull())
    heights = (_by_page(known.select("doc_id", "page", "bottom", "left_x", "right_x", "word")).groupBy("doc_id", "page", "bottom")
               .agg(F.collect_list(F.struct("left_x", "right_x", "word")).alias("_words")))
    placed = _lines(heights, ["_words"]).select("doc_id", "page", "bottom", "line_no", F.inline("_words"))
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("left_x", F.col("bottom").desc())
    gap = F.col("left_x") - F.lag("right_x").over(w)
    lead = F.when(gap.isNull(), F.lit("")).when(gap > COLUMN_GAP, F.lit(" | ")).otherwise(F.lit(" "))
    pieces = placed.select("doc_id", "page", "line_no", F.row_number().over(w).alias("_at"), F.concat(lead, "word").alias("_piece"))
    return (pieces.groupBy("doc_id", "page", "line_no").agg(join_text("_piece", "_at", "").alias("line"))
            .withColumn("line", text.join_model_suffix("line")))


def page_text(lines: DataFrame) -> DataFrame:
    """Document text with page markers from rendered lines."""
    pages = lines.groupBy("doc_id", "page").agg(join_text("line", "line_no", "\n").alias("body"))
    marked = pages.withColumn("body", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "body", F.lit("\n\n")))
    return (marked.groupBy("doc_id").agg(join_text("body", "page", "").alias("text"))
            .withColumn("text", text.cleanup_page_artifacts(text.join_model_suffix("text"))))


# ── sheets ────────────────────────────────────────────────────────────────────


def merged_cell_fill(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Empty cells inside a merged range take the value of its first cell.

    Ranges are written out as the cells they cover and joined by position.  Each
    cell lies in one range at most, so that is never more rows than there are
    cells, where a between-join would compare every cell of a sheet with every range.
    """
    covered = (merged.withColumn("row_no", F.explode(F.sequence("r1", "r2"))).withColumn("col_no", F.explode(F.sequence("c1", "c2")))
               .groupBy(*_SHEET, "row_no", "col_no").agg(F.min(F.struct("r1", "c1")).alias("_m")))
    first = (merged.select(*_SHEET, F.col("r1").alias("row_no"), F.col("c1").alias("col_no")).distinct()
             .join(cells, [*_SHEET, "row_no", "col_no"])
             .select(*_SHEET, F.struct(F.col("row_no").alias("r1"), F.col("col_no").alias("c1")).alias("_m"),
                     F.col("value").alias("_shared")))
    shared = covered.join(first, [*_SHEET, "_m"]).drop("_m")
    return (cells.join(shared, [*_SHEET, "row_no", "col_no"], "left")
            .withColumn("value", F.when(F.length(F.coalesce("value", F.lit(""))) > 0, F.col("value")).otherwise(F.col("_shared")))
            .withColumn("value", F.coalesce("value", F.lit(""))).drop("_shared"))


def sheet_bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*_SHEET).agg(
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("col_no").alias("first_col"),
        F.max("col_no").alias("last_col"), F.max("sheet_name").alias("sheet_name"))


def header_depth(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Header rows per sheet: one more than the leading rows, four at most, that open a horizontal merge."""
    bounds = sheet_bounds(cells)
    wide = (merged.join(bounds, _SHEET).where((F.col("c2") > F.col("c1")) & (F.col("c1") >= F.col("first_col"))
                                              & (F.col("c2") <= F.col("last_col")) & (F.col("r1") < F.col("last_row"))))
    step = F.col("r1") - F.col("first_row")
    found = wide.where(step.between(0, 3)).groupBy(*_SHEET).agg(F.collect_set(step).alias("_rows"))  # four values at most
    depth = F.lit(1)
    for n in (1, 2, 3, 4):
        all_there = F.forall(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains("_rows", k))
        depth = F.when(F.coalesce(all_there, F.lit(False)), n + 1).otherwise(depth)
    return bounds.join(found, _SHEET, "left").withColumn("depth", depth).drop("_rows")


def qualified_headers(filled: DataFrame, depth: DataFrame) -> DataFrame:
    """Column names from one or several header rows: doc_id, sheet_no, col_no, header."""
    head = (filled.drop("sheet_name").join(depth.select(*_SHEET, "first_row", "first_col", "depth"), _SHEET)
            .where(F.col("row_no") < F.col("first_row") + F.col("depth")))
    parts = head.groupBy(*_SHEET, "col_no", "first_col", "depth").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_no", "value"))), lambda x: x["value"]).alias("_values"))  # five rows at most
    clean = text.distinct_ignoring_case(F.filter(F.transform("_values", text.strip), lambda v: F.length(v) > 0))
    named = parts.withColumn("_name", F.btrim(F.array_join(clean, "_"), F.lit("_")))
    same = Window.partitionBy(*_SHEET, F.lower("_name"))
    numbered = (named.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_i", F.row_number().over(same.orderBy("col_no"))))
    many = (F.when(text.is_blank("_name"), F.concat(F.lit("Col"), (F.col("col_no") - F.col("first_col") + 1).cast("string")))
            .when(F.col("_n") > 1, F.concat("_name", F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("_name")))
    single = F.get("_values", F.lit(0))
    return numbered.select(*_SHEET, "col_no", text.escape_cell(F.when(F.col("depth") > 1, many).otherwise(single)).alias("header"))


def _row_texts(filled: DataFrame, depth: DataFrame) -> DataFrame:
    body = (filled.drop("sheet_name").join(depth.select(*_SHEET, "first_row", "depth"), _SHEET)
            .where(F.col("row_no") >= F.col("first_row") + F.col("depth")).withColumn("_cell", text.escape_cell("value")))
    return (body.groupBy(*_SHEET, "row_no").agg(join_text("_cell", "col_no", " | ").alias("line"))
            .withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |"))))


def _sheet_head(filled: DataFrame, depth: DataFrame) -> DataFrame:
    """Marker, header and rule of each sheet as ``head``."""
    heads = qualified_headers(filled, depth).withColumn("_dash", F.repeat(F.lit("-"), F.greatest(F.lit(3), F.length("header"))))
    top = heads.groupBy(*_SHEET).agg(join_text("header", "col_no", " | ").alias("_h"), join_text("_dash", "col_no", " | ").alias("_d"))
    return depth.select(*_SHEET, "sheet_name").join(top, _SHEET).select(*_SHEET, F.concat(
        F.lit("--- Sheet: "), "sheet_name", F.lit(" ---\n| "), "_h", F.lit(" |\n| "), "_d", F.lit(" |\n")).alias("head"))


def sheet_render(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Markdown text of each sheet with its marker, header and rule: doc_id, sheet_no, text."""
    filled, depth = merged_cell_fill(cells, merged), header_depth(cells, merged)
    rows = _row_texts(filled, depth).groupBy(*_SHEET).agg(join_text("line", "row_no", "\n").alias("_rows"))
    return _sheet_head(filled, depth).join(rows, _SHEET, "left").select(
        *_SHEET, F.concat("head", F.coalesce(F.concat("_rows", F.lit("\n")), F.lit("")), F.lit("\n")).alias("text"))


def sheet_parts(cells: DataFrame, merged: DataFrame, part_chars: int = DEFAULTS.full_document_chars) -> DataFrame:
    """The same texts as parts of about ``part_chars`` characters: doc_id, sheet_no, part_no, text; a large sheet is many rows here."""
    filled, depth = merged_cell_fill(cells, merged), header_depth(cells, merged)
    place = lambda kind, row: F.struct(F.lit(kind).alias("kind"), row.cast("int").alias("row_no")).alias("_at")
    head = _sheet_head(filled, depth)
    pieces = (head.select(*_SHEET, place(0, F.lit(0)), F.col("head").alias("piece"))
              .union(_row_texts(filled, depth).select(*_SHEET, place(1, F.col("row_no")), F.concat("line", F.lit("\n"))))
              .union(head.select(*_SHEET, place(2, F.lit(0)), F.lit("\n"))))
    return text_parts(cut_lineage(pieces), _SHEET, "_at", "piece", part_chars)


def sheet_extract_stats(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Header rows, data rows, columns, circuit codes, first and last row of each sheet."""
    filled, depth = merged_cell_fill(cells, merged), header_depth(cells, merged)
    rows = _row_texts(filled, depth).groupBy(*_SHEET).agg(
        F.count(F.lit(1)).alias("data_rows"), F.sum(F.regexp_count("line", F.lit(vocab.CIRCUIT_CODE))).alias("circuit_codes"),
        F.min_by("line", "row_no").alias("first_line"), F.max_by("line", "row_no").alias("last_line"))
    return depth.join(rows, _SHEET, "left").select(
        *_SHEET, F.col("depth").alias("header_rows"), F.coalesce("data_rows", F.lit(0)).alias("data_rows"),
        (F.col("last_col") - F.col("first_col") + 1).alias("columns"), F.coalesce("circuit_codes", F.lit(0)).alias("circuit_codes"),
        "first_line", "last_line")
