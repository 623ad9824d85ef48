"""Tables found in document text.

``table_rows`` is the working form: one row per table line with its cells as an
array and the sheet's columns beside it.  Cells are exploded only where every
cell is needed; a question about one column picks that element of the array.

  texts   doc_set_id, doc_id, document_type, text
  rows    doc_set_id, sheet_no, sheet_name, doc_id, row_no, is_header, columns, cells
  sheets  doc_set_id, sheet_no, sheet_name, columns, n_rows
  headers doc_set_id, sheet_no, n_rows, col_no, col_name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant import vocab
from foliant.functions import columns as names, text
from foliant.plans.ranking import exclusive_running, order_buckets
from foliant.session import cut_columns, cut_lineage

#: Table lines that one task takes apart, and tasks at most.
TASK_LINES, MOST_TASKS = 100_000, 4000
_SHEET_LINE = r"(?mdU)^[^\S\n]*---[^\S\n]*Sheet:[^\S\n]*(.+?)[^\S\n]*---[^\S\n]*$"
_RULE_LINE = r"(?U)^\|[\s\-|:]+\|$"
_ESCAPED = "\x01"
ROW_COLUMNS = ["doc_set_id", "sheet_no", "sheet_name", "doc_id", "row_no", "is_header", "columns", "cells"]


# ── Markdown tables ───────────────────────────────────────────────────────────


def split_row(line: Column) -> Column:
    """Cells of a trimmed pipe row; an escaped pipe stays inside its cell."""
    inner = F.substring(line, F.lit(2), F.length(line) - 2)
    parts = F.split(F.replace(inner, F.lit("\\|"), F.lit(_ESCAPED)), r"\|", -1)
    return F.transform(parts, lambda c: text.strip(F.replace(c, F.lit(_ESCAPED), F.lit("|"))))


def table_lines(block: Column) -> Column:
    """Trimmed pipe rows of a block of text without the rules under headers."""
    trimmed = F.transform(text.lines(block), text.strip)
    return F.filter(trimmed, lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|"))
                    & (F.length(x) >= 3) & ~x.rlike(_RULE_LINE))


def pad_or_trim(cells: Column, width: Column) -> Column:
    """A row forced to the header's width: missing cells empty, extra ones dropped.

    ``cells`` stays out of the function over the elements, which would work it out once per column.
    """
    some = F.coalesce(cells, F.array().cast("array<string>"))
    return F.transform(F.slice(F.concat(some, F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda c: F.coalesce(c, F.lit("")))


def _blocks(texts: DataFrame) -> DataFrame:
    """One row per document and sheet marker; block 0 is the text before the first marker."""
    return (texts.where(~text.is_blank("text"))
            .select("doc_set_id", "doc_id", F.regexp_extract_all("text", F.lit(_SHEET_LINE), F.lit(1)).alias("_names"),
                    F.split("text", _SHEET_LINE, -1).alias("_parts"))
            .select("doc_set_id", "doc_id", "_names", F.posexplode("_parts").alias("block", "_part"))
            .select("doc_set_id", "doc_id", "block", text.strip(F.get("_names", F.col("block") - 1)).alias("name"),
                    table_lines(F.col("_part")).alias("lines")))


def _spread(df: DataFrame, lines: float | None, keys: list[str]) -> DataFrame:
    """Rows of lines dealt to tasks by ``keys``: taking lines apart is far more work than their bytes tell, and a set may hold most of them."""
    return df.repartition(int(min(MOST_TASKS, max(df.sparkSession.sparkContext.defaultParallelism, (lines or 0) // TASK_LINES + 1))), *keys)


def _summary(blocks: DataFrame) -> DataFrame:
    """One short row per document, read by several steps: cut off from the parsing behind it."""
    first = F.get("lines", F.lit(0))
    return cut_lineage(blocks.groupBy("doc_set_id", "doc_id").agg(
        F.max("block").alias("markers"), F.max_by(F.struct("name", first.alias("first")), "block").alias("last"),
        F.max(F.when(F.col("block") == 0, first)).alias("lead"), F.bool_or(F.size("lines") > 0).alias("has_table"),
        F.sum(F.size("lines")).alias("n_lines")))


def table_rows(texts: DataFrame) -> DataFrame:
    """Every table row of every document set.

    The texts of a set are read one after another, so rows before a document's
    first sheet marker continue the last sheet of the documents before it.
    That needs only a one-row summary per document: markers so far (prefix sum
    in two levels) and, per run of documents without a new sheet, the first row
    seen, which is the header.
    """
    blocks = cut_columns(_blocks(texts))
    return _rows(blocks, _summary(blocks))


def _rows(blocks: DataFrame, summary: DataFrame) -> DataFrame:
    placed = exclusive_running(order_buckets(summary, ["doc_set_id"], "doc_id", name="_place"), ["doc_set_id"], F.col("_place"), "doc_id",
                               {"sheet_base": F.col("markers"), "run": (F.col("markers") > 0).cast("int")}, {})
    parts = F.array(
        F.struct(F.col("run").alias("run"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("name"),
                 F.col("lead").alias("first")),
        F.struct((F.col("run") + 1).alias("run"), F.lit(1).alias("part"), F.col("last.name").alias("name"),
                 F.when(F.col("markers") > 0, F.col("last.first")).alias("first")))
    runs = (placed.select("doc_set_id", "doc_id", F.explode(parts).alias("p"))
            .groupBy("doc_set_id", "p.run").agg(
                F.min_by(F.struct("doc_id", "p.part", "p.first"),
                         F.when(F.col("p.first").isNotNull(), F.struct("doc_id", "p.part"))).alias("head"),
                F.max("p.name").alias("run_name")))
    state = placed.select("doc_set_id", "doc_id", "run", "sheet_base").join(runs, ["doc_set_id", "run"])

    total = summary.agg(F.sum("n_lines")).first()[0]
    joined = _spread(blocks.where(F.size("lines") > 0).join(state, ["doc_set_id", "doc_id"]), total, ["doc_set_id", "doc_id", "block"])
    lead = F.col("block") == 0
    own_head = ~lead | ((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.part") == 0))
    head_line = F.when(lead, F.col("head.first")).otherwise(F.get("lines", F.lit(0)))
    with_header = joined.select(
        "doc_set_id", (F.col("sheet_base") + F.col("block")).alias("sheet_no"),
        F.coalesce(F.when(lead, F.col("run_name")).otherwise(F.col("name")), F.lit("")).alias("sheet_name"),
        "doc_id", split_row(head_line).alias("columns"), own_head.alias("_own"),
        F.posexplode("lines").alias("row_no", "_line"))
    return with_header.select(
        "doc_set_id", "sheet_no", "sheet_name", "doc_id", "row_no",
        (F.col("_own") & (F.col("row_no") == 0)).alias("is_header"), "columns",
        pad_or_trim(split_row(F.col("_line")), F.size("columns")).alias("cells"))


# ── delimited text ────────────────────────────────────────────────────────────


def split_delimited(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line; quotes may open anywhere and "" inside them is one quote.

    Written with possessive groups so that long lines neither backtrack nor
    recurse per character.
    """
    out = None
    for ch, pat in (("\t", r"\t"), (";", ";"), (",", ",")):
        field = rf'{pat}([^"{pat}]*+(?:"[^"]*+(?:""[^"]*+)*+(?:"|$)[^"{pat}]*+)*+)'
        raw = F.regexp_extract_all(F.concat(F.lit(ch), line), F.lit(field), F.lit(1))
        out = F.when(delimiter == ch, raw) if out is None else out.when(delimiter == ch, raw)
    return F.transform(out, lambda f: text.strip(F.replace(
        F.regexp_replace(f, r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"'))))


def delimited_rows(texts: DataFrame) -> DataFrame:
    """One table per document set: the first line of its first document names the columns."""
    filled = (texts.where(~text.is_blank("text"))
              .select("doc_set_id", "doc_id", F.filter(text.lines("text"), lambda x: F.length(x) > 0).alias("_lines"))
              .where(F.size("_lines") > 0))
    head = filled.groupBy("doc_set_id").agg(
        F.min(F.struct("doc_id", F.get("_lines", F.lit(0)).alias("line"))).alias("head"),
        F.sum(F.size("_lines")).alias("n")).where(F.col("n") >= 2)
    head = cut_lineage(head.select("doc_set_id", "n", F.col("head.doc_id").alias("_head_doc"),
                                   text.sniff_delimiter("head.line").alias("_delimiter"), F.col("head.line").alias("_head")))
    total = head.agg(F.sum("n")).first()[0]
    head = head.withColumn("columns", split_delimited(F.col("_head"), F.col("_delimiter")))
    exploded = (_spread(filled.join(head.drop("n"), "doc_set_id"), total, ["doc_set_id", "doc_id"])
                .select("doc_set_id", "doc_id", "columns", "_delimiter", "_head_doc",
                        F.posexplode("_lines").alias("row_no", "_line")))
    is_head = (F.col("doc_id") == F.col("_head_doc")) & (F.col("row_no") == 0)
    return (exploded.where(is_head | ~text.is_blank("_line"))
            .select("doc_set_id", F.lit(1).cast("bigint").alias("sheet_no"), F.lit("Sheet1").alias("sheet_name"),
                    "doc_id", "row_no", is_head.alias("is_header"), "columns",
                    pad_or_trim(split_delimited(F.col("_line"), F.col("_delimiter")), F.size("columns")).alias("cells")))


def load_tables(texts: DataFrame) -> DataFrame:
    """Markdown tables; document sets of spreadsheets without any are read as delimited text."""
    texts = cut_columns(texts)  # read by three steps: texts may be the end of long work
    blocks = _blocks(texts)
    summary = _summary(blocks)
    plain = (texts.where(F.col("document_type").isin(vocab.TABLE_DOCUMENT_TYPES))
             .join(summary.where("has_table").select("doc_set_id").distinct(), "doc_set_id", "left_anti"))
    return (_rows(blocks, summary).select(*ROW_COLUMNS)
            .unionByName(delimited_rows(plain).select(*ROW_COLUMNS)))


# ── long and summary forms ────────────────────────────────────────────────────


def markdown_cells(rows: DataFrame) -> DataFrame:
    """Long form: one row per data cell."""
    return (rows.where(~F.col("is_header"))
            .select("doc_set_id", "sheet_no", "sheet_name", "doc_id", "row_no", "columns",
                    F.posexplode("cells").alias("col_no", "value"))
            .withColumn("col_name", F.get("columns", F.col("col_no"))).drop("columns"))


def sheets_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_set_id", "sheet_no").agg(
        F.first("sheet_name").alias("sheet_name"), F.first("columns").alias("columns"),
        F.sum((~F.col("is_header")).cast("bigint")).alias("n_rows"))


def headers_of(sheets: DataFrame) -> DataFrame:
    return sheets.select("doc_set_id", "sheet_no", "n_rows", F.posexplode("columns").alias("col_no", "col_name"))


# ── column resolution ─────────────────────────────────────────────────────────


def find_best_column(concepts: DataFrame, headers: DataFrame) -> DataFrame:
    """Column of a document set that stands for a concept: same flattened name, same
    alias group, or same canonical name.  ``concepts``: doc_set_id, concept."""
    asked = (concepts.select("doc_set_id", "concept").distinct()
             .withColumn("_flat", names.flatten_name("concept")).withColumn("_group", names.concept_of("concept")))
    heads = headers.select("doc_set_id", "sheet_no", "col_no", "col_name", names.flatten_name("col_name").alias("_cf"),
                           names.concept_of("col_name").alias("_cg"))
    spot = F.struct("sheet_no", "col_no", "col_name")
    by_name = (heads.groupBy("doc_set_id", F.col("_cf").alias("_flat")).agg(F.min(spot).alias("spot")))
    by_group = (heads.where(F.col("_cg").isNotNull()).groupBy("doc_set_id", F.col("_cg").alias("_group"))
                .agg(F.min(spot).alias("spot")))
    exact = asked.join(by_name, ["doc_set_id", "_flat"]).select("doc_set_id", "concept", F.lit(1).alias("step"), "spot")
    grouped = asked.join(by_group, ["doc_set_id", "_group"]).select("doc_set_id", "concept", F.lit(2).alias("step"), "spot")
    return (exact.unionByName(grouped).groupBy("doc_set_id", "concept")
            .agg(F.min(F.struct("step", "spot")).alias("best"))
            .select("doc_set_id", "concept", F.col("best.spot.col_name").alias("col_name")))


def concept_columns(headers: DataFrame) -> DataFrame:
    """Best column per document set and concept: doc_set_id, concept, kind, spot.

    kind "alias" holds columns whose name is an alias of the concept, "part"
    those whose flattened name merely contains it.  At most a few rows per set.
    """
    heads = headers.where(~text.is_blank("col_name")).withColumn("_flat", names.flatten_name("col_name"))
    concept = names.concept_of("col_name")
    alias = (heads.withColumn("concept", concept).where(F.col("concept").isNotNull())
             .withColumn("_sub", F.when(F.col("_flat") == F.col("concept"), 1).otherwise(2)))
    wanted = F.array(*[F.lit(c) for c, _ in vocab.CONCEPT_TERMS])
    part = (heads.withColumn("concept", F.explode(F.filter(wanted, lambda c: F.contains(F.col("_flat"), c))))
            .withColumn("_sub", F.lit(1)))
    spot = F.struct((-F.col("n_rows")).alias("size"), "sheet_no", "_sub", "col_no", "col_name")
    return (alias.select("*", F.lit("alias").alias("kind")).unionByName(part.select("*", F.lit("part").alias("kind")))
            .groupBy("doc_set_id", "concept", "kind").agg(F.min(spot).alias("spot")))


def resolve_target_column(queries: DataFrame, headers: DataFrame) -> DataFrame:
    """Column a question is about: query_id, doc_set_id, col_name.

    In order of preference: a column name inside the question, the canonical
    name of a column inside it, a concept word with an aliased column, a
    concept word inside a column name.  Larger tables win.  Only distinct names
    and one row per concept of a document set meet the questions.
    """
    asked = queries.select("query_id", "doc_set_id", F.lower("query_text").alias("_q"))
    heads = headers.where(~text.is_blank("col_name"))
    distinct_names = (heads.withColumn("_low", F.lower("col_name")).groupBy("doc_set_id", "_low")
                      .agg(F.min(F.struct((-F.col("n_rows")).alias("size"), "sheet_no", "col_no", "col_name")).alias("spot")))
    concepts = concept_columns(headers)

    def found(df: DataFrame, step: int, concept_no: Column, sub: Column) -> DataFrame:
        return df.select("query_id", "doc_set_id", F.struct(
            F.lit(step).alias("step"), concept_no.cast("int").alias("concept_no"), F.col("spot.size"),
            F.col("spot.sheet_no"), sub.cast("int").alias("sub"), F.col("spot.col_no"), F.col("spot.col_name")).alias("hit"))

    zero = F.lit(0)
    by_name = asked.join(distinct_names, "doc_set_id").where(F.contains("_q", "_low"))
    all_concepts = F.array(*[F.lit(c) for c, _ in vocab.COLUMN_ALIASES])
    named = asked.withColumn("concept", F.explode(F.filter(all_concepts, lambda c: F.contains(F.col("_q"), F.lower(c)))))
    aliases = concepts.where(F.col("kind") == "alias")
    # the canonical-name step takes plain column order inside a table
    plain = (heads.withColumn("concept", names.concept_of("col_name")).where(F.col("concept").isNotNull())
             .groupBy("doc_set_id", "concept")
             .agg(F.min(F.struct((-F.col("n_rows")).alias("size"), "sheet_no", "col_no", "col_name")).alias("spot")))
    by_canonical = named.join(plain, ["doc_set_id", "concept"])
    terms = F.array(*[F.when(F.col("_q").rlike("|".join(words)), F.struct(F.lit(i).alias("no"), F.lit(c).alias("concept")))
                      for i, (c, words) in enumerate(vocab.CONCEPT_TERMS)])
    meant = (asked.withColumn("_t", F.explode(F.filter(terms, lambda x: x.isNotNull())))
             .select("query_id", "doc_set_id", F.col("_t.no").alias("_no"), F.col("_t.concept").alias("concept")))
    by_alias = meant.join(aliases, ["doc_set_id", "concept"])
    by_part = meant.join(concepts.where(F.col("kind") == "part"), ["doc_set_id", "concept"])
    hits = (found(by_name, 1, zero, zero).unionByName(found(by_canonical, 2, zero, zero))
            .unionByName(found(by_alias, 3, F.col("_no"), F.col("spot._sub")))
            .unionByName(found(by_part, 4, F.col("_no"), zero)))
    return (hits.groupBy("query_id", "doc_set_id").agg(F.min("hit").alias("hit"))
            .select("query_id", "doc_set_id", F.col("hit.col_name").alias("col_name")))


def sheet_columns(wanted: DataFrame, headers: DataFrame) -> DataFrame:
    """Where named columns sit: the first column of that name (any case) in each sheet.

    ``wanted``: doc_set_id, col_name.  Output: doc_set_id, target, sheet_no, col_no.
    """
    keys = wanted.select("doc_set_id", F.lower("col_name").alias("target")).distinct()
    return (headers.withColumn("target", F.lower("col_name")).join(keys, ["doc_set_id", "target"], "left_semi")
            .groupBy("doc_set_id", "target", "sheet_no").agg(F.min("col_no").alias("col_no")))


def column_values(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Values at the given places: doc_set_id, target, sheet_no, doc_id, row_no, value."""
    return (rows.where(~F.col("is_header")).select("doc_set_id", "sheet_no", "doc_id", "row_no", "cells")
            .join(places, ["doc_set_id", "sheet_no"])
            .select("doc_set_id", "target", "sheet_no", "doc_id", "row_no", F.get("cells", F.col("col_no")).alias("value")))
