"""Answers about some rows of a table: those that meet a condition, and figures per group.

Conditions, group columns and measures are read from the question; columns are
found as for the other exact answers.  Cells are reduced per distinct value (or
group) before they meet the questions, and equal conditions of many questions
are worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant import vocab
from foliant.functions import intents, numbers, text
from foliant.operators import tables as tb
from foliant.options import DEFAULTS, Options
from foliant.plans.ranking import top_per_group
from foliant.plans.scopes import pair_up
from foliant.session import cut_columns, cut_lineage

_SPOT = ["doc_set_id", "target"]

# ── conditions ────────────────────────────────────────────────────────────────


def row_conditions(queries: DataFrame) -> DataFrame:
    """Questions with a condition: low and high (both exclusive), equals, and whether the numbers have units.

    "above 100", "below 2,000", "över 1G" and "where status is open" are understood, a bound of each kind at most.
    """
    q = F.lower("query_text")

    def bound(pattern: str) -> tuple[Column, Column]:
        number, unit = F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)
        value = F.when(unit != "", numbers.parse_bandwidth(F.concat(number, unit))).otherwise(numbers.parse_numeric(number))
        return F.when(number != "", value), unit

    (low, low_unit), (high, high_unit) = bound(vocab.ABOVE_NUMBER), bound(vocab.BELOW_NUMBER)
    equals = F.regexp_extract(q, vocab.EQUALS_VALUE, 1)
    found = queries.select("query_id", "doc_set_id", "query_text", low.alias("low"), high.alias("high"), F.when(equals != "", equals).alias("equals"),
                           (F.concat(low_unit, high_unit) != "").alias("unit"))
    found = found.where(F.col("low").isNotNull() | F.col("high").isNotNull() | F.col("equals").isNotNull())
    return found.withColumn("condition", F.to_json(F.struct("low", "high", "equals", "unit")))


def _read(df: DataFrame, value: str) -> DataFrame:
    """Adds what a cell says as a plain number, as Mbps and as text: read once, compared many times."""
    return df.withColumns({"_plain": numbers.parse_numeric(value), "_mbps": numbers.parse_bandwidth(value), "_text": F.lower(text.strip(value))})


def _meets() -> Column:
    number = F.when(F.col("unit"), F.col("_mbps")).otherwise(F.col("_plain"))
    return ((F.col("low").isNull() | F.coalesce(number > F.col("low"), F.lit(False)))
            & (F.col("high").isNull() | F.coalesce(number < F.col("high"), F.lit(False)))
            & (F.col("equals").isNull() | (F.col("_text") == F.col("equals"))) & (F.col("_text") != ""))


def _conditioned(queries: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with condition and column, and the distinct conditions on a column."""
    asked = cut_lineage(row_conditions(queries))  # questions are few next to cells: their patterns are not dragged along
    named = cut_lineage(asked.join(tb.resolve_target_column(asked, headers), ["query_id", "doc_set_id"]).withColumn("target", F.lower("col_name")))
    return named, named.select(*_SPOT, "condition", "low", "high", "equals", "unit").distinct()


def filter_answers(queries: DataFrame, rows: DataFrame, headers: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Rows that meet each question's condition: query_id, doc_set_id, column_used, matching, distinct_values, first_values.

    A condition is tried once per distinct value of its column, not once per row.
    """
    named, conditions = _conditioned(queries, headers)
    values = tb.column_values(tb.sheet_columns(named, headers), rows)
    spelled = values.groupBy(*_SPOT, "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sheet_no", "doc_id", "row_no")).alias("at"))
    keys = [*_SPOT, "condition"]
    met = cut_lineage(_read(spelled, "value")).join(conditions, _SPOT).where(_meets()).groupBy(*keys, F.lower("value").alias("_low")).agg(
        F.sum("n").alias("n"), F.min(F.struct("at", "value")).alias("first"))
    first = (top_per_group(met.select(*keys, "first"), keys, [F.col("first")], options.first_values, "_r").groupBy(*keys)
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["value"]), ",").alias("first_values")))
    figures = met.groupBy(*keys).agg(F.sum("n").alias("matching"), F.count(F.lit(1)).alias("distinct_values")).join(first, keys)
    return named.join(figures, keys, "left").select(
        "query_id", "doc_set_id", F.col("col_name").alias("column_used"), F.coalesce("matching", F.lit(0)).alias("matching"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), F.coalesce("first_values", F.lit("")).alias("first_values"))


def filtered_rows(queries: DataFrame, rows: DataFrame, headers: DataFrame, shown: Column | None = None) -> DataFrame:
    """The rows themselves: query_id, doc_set_id, sheet_no, sheet_name, doc_id, row_no, columns, cells, or ``shown`` (read once per row) as row
    in place of the last two.

    Rows are found once per distinct condition and given to its questions; both times they meet in blocks, so that a hot table or condition
    is spread over tasks.
    """
    named, conditions = _conditioned(queries, headers)
    places = tb.sheet_columns(named, headers)
    data = rows.where(~F.col("is_header")).join(places, ["doc_set_id", "sheet_no"]).withColumn("_cell", F.get("cells", F.col("col_no")))
    if shown is not None:
        data = data.withColumn("row", shown)
    told = ["sheet_no", "sheet_name", "doc_id", "row_no", *(["columns", "cells"] if shown is None else ["row"])]
    spot, place = F.to_json(F.struct(*_SPOT)), F.to_json(F.struct(*_SPOT, "condition"))
    read = _read(data, "_cell").where(F.col("_text") != "").select(spot.alias("query_id"), "_plain", "_mbps", "_text", *told)
    tried = conditions.select(place.alias("query_id"), spot.alias("scope_id"), "doc_set_id", "low", "high", "equals", "unit")
    met = cut_columns(pair_up(tried, read).where(_meets()).select("query_id", "doc_set_id", *told))
    return pair_up(named.select("query_id", place.alias("scope_id")), met).select("query_id", "doc_set_id", *told)


# ── groups ────────────────────────────────────────────────────────────────────


def group_requests(queries: DataFrame, headers: DataFrame) -> DataFrame:
    """Questions for figures per group: query_id, doc_set_id, group_column, measure, measure_column.

    What follows the last "per", "by" or "efter" names the group, what stands before it the measure.
    """
    q = F.lower("query_text")
    parts = queries.select("query_id", "doc_set_id", F.regexp_extract(q, vocab.GROUP_PARTS, 1).alias("_measure"),
                           F.regexp_extract(q, vocab.GROUP_PARTS, 2).alias("_group")).where(F.col("_group") != "")
    column = lambda part, name: tb.resolve_target_column(
        parts.select("query_id", "doc_set_id", F.col(part).alias("query_text")), headers).withColumnRenamed("col_name", name)
    intent = intents.classify_intent("_measure")
    measure = F.when(intent.isin("Sum", "Average", "Maximum", "Minimum"), intent).otherwise(F.lit("Count"))
    parts = cut_lineage(parts)
    found = (parts.join(column("_group", "group_column"), ["query_id", "doc_set_id"])
             .join(column("_measure", "measure_column"), ["query_id", "doc_set_id"], "left").withColumn("measure", measure))
    counted = F.col("measure") == "Count"
    return (found.where(counted | F.col("measure_column").isNotNull())
            .select("query_id", "doc_set_id", "group_column", "measure", F.when(~counted, F.col("measure_column")).alias("measure_column")))


def group_answers(queries: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Figures per group: query_id, doc_set_id, group_column, measure, measure_column, group_value, n, value.

    Each pair of group and measure column is aggregated once, with partial figures before the shuffle, and joined to
    all questions about it.  Groups ignore case; numbers add up as decimals, so the order of rows is of no account.
    """
    asked = cut_lineage(group_requests(queries, headers)).withColumn("target", F.lower("group_column")).withColumn(
        "of", F.coalesce(F.lower("measure_column"), F.lit("")))
    spots = asked.select("doc_set_id", F.explode(F.array("group_column", "measure_column")).alias("col_name")).where(F.col("col_name").isNotNull())
    places = tb.sheet_columns(spots, headers)
    measured = places.select("doc_set_id", "sheet_no", F.col("target").alias("of"), F.col("col_no").alias("of_no"))
    pairs = asked.select("doc_set_id", "target", "of").distinct().join(places, _SPOT).join(measured, ["doc_set_id", "sheet_no", "of"], "left")
    pairs = pairs.where((F.col("of") == "") | F.col("of_no").isNotNull())
    cells = (rows.where(~F.col("is_header")).select("doc_set_id", "sheet_no", "cells").join(pairs, ["doc_set_id", "sheet_no"])
             .select("doc_set_id", "target", "of", text.strip(F.get("cells", F.col("col_no"))).alias("group"),
                     numbers.parse_numeric(F.get("cells", F.col("of_no"))).alias("x")))
    keys = ["doc_set_id", "target", "of"]
    figures = cells.groupBy(*keys, F.lower("group").alias("_low")).agg(
        F.min("group").alias("group_value"), F.count(F.lit(1)).alias("n"), F.count("x").alias("_n"),
        F.sum(F.col("x").cast("decimal(30,6)")).cast("double").alias("_sum"), F.max("x").alias("_max"), F.min("x").alias("_min"))
    value = (F.when(F.col("measure") == "Count", F.col("n").cast("double")).when(F.col("measure") == "Sum", F.col("_sum"))
             .when(F.col("measure") == "Average", F.col("_sum") / F.col("_n")).when(F.col("measure") == "Maximum", F.col("_max")).otherwise(F.col("_min")))
    return asked.join(figures, keys).select("query_id", "doc_set_id", "group_column", "measure", "measure_column", "group_value", "n", value.alias("value"))
