"""Exact answers calculated over document tables, for many questions in one job.

Figures are computed once per document set and column, whatever the number of
questions about it, and joined to the questions at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant import vocab
from foliant.functions import columns as names, intents, numbers, text
from foliant.operators import tables as tb
from foliant.options import DEFAULTS, Options
from foliant.plans.ranking import top_per_group
from foliant.session import cut_columns, cut_lineage

ANSWER = ["query_id", "doc_set_id", "value", "confidence", "method", "rows_processed", "column_used", "sheet_name",
          "is_exact", "column_matched", "fallback_extractor", "values_extracted", "distinct_values", "rejected_rows",
          "first_values", "extractor_name", "extractor_version", "extractor_priority", "extractor_order"]
_VLAN_TARGET = "\x00vlan"


# ── extractors ────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Basis:
    """What extractors answer from, made once for all of them.

    ``rows``, ``sheets``, ``headers``, ``totals``: the tables; ``eligible``: questions with the extractors that may answer them;
    ``targets``: the same with the column they are about; ``asked``: those with a column, joined to its figures.
    """

    rows: DataFrame
    sheets: DataFrame
    headers: DataFrame
    totals: DataFrame
    eligible: DataFrame
    targets: DataFrame
    asked: DataFrame
    options: Options


@dataclass(frozen=True)
class Extractor:
    """A way to answer a class of questions: who may ask it, and its answers as ``answer_rows``.

    ``eligible`` is a condition on intent and lower-case text; with equal confidence the higher priority wins, then more
    values, then the earlier registration.  ``needs_column``: whether the question's column is to be looked up.
    """

    name: str
    version: str
    priority: int
    eligible: Callable[[Column, Column], Column]
    answers: Callable[[Basis], DataFrame]
    needs_column: bool = True


_REGISTRY: dict[str, Extractor] = {}


def register_extractor(extractor: Extractor) -> Extractor:
    """Add an extractor, or replace the one of that name in its place."""
    _REGISTRY[extractor.name] = extractor
    return extractor


def unregister_extractor(name: str) -> None:
    _REGISTRY.pop(name, None)


def extractors() -> list[Extractor]:
    """The registered extractors in the order of their registration."""
    return list(_REGISTRY.values())


def serves(served: list[str], terms: list[str] | None) -> Callable[[Column, Column], Column]:
    """Eligibility by intent and, where given, by words in the question."""
    return lambda intent, q: intent.isin(served) & (intents.mentions(q, terms) if terms else F.lit(True))


# ── eligibility ───────────────────────────────────────────────────────────────


def extractor_eligibility(queries: DataFrame) -> DataFrame:
    """Which extractors may answer a question: query_id, doc_set_id, intent, query_text, extractor."""
    q = F.lower("query_text")
    offers = [F.when(e.eligible(F.col("intent"), q), F.lit(e.name)) for e in extractors()]
    return queries.withColumn("extractor", F.explode(F.array_compact(F.array(*offers))))


def classify(queries: DataFrame) -> DataFrame:
    return queries.withColumn("intent", intents.classify_intent("query_text"))


def set_totals(sheets: DataFrame) -> DataFrame:
    """Rows per document set and its only named sheet, for sets that have any data row."""
    named = F.length("sheet_name") > 0
    return (sheets.groupBy("doc_set_id").agg(
        F.sum("n_rows").alias("total_rows"), F.sum(named.cast("int")).alias("_named"),
        F.max(F.when(named, F.col("sheet_name"))).alias("_sheet"))
        .where(F.col("total_rows") > 0)
        .select("doc_set_id", "total_rows", F.when(F.col("_named") == 1, F.col("_sheet")).alias("only_sheet")))


# ── figures per column ────────────────────────────────────────────────────────


def column_figures(values: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """All figures any question may ask of a column: doc_set_id, target, ….

    Values are first reduced per distinct spelling, so a column with few
    distinct values shrinks before anything is shuffled again.
    """
    keys = ["doc_set_id", "target"]
    plain, mbps = numbers.parse_numeric("value"), numbers.parse_bandwidth("value")
    place = F.struct("sheet_no", "doc_id", "row_no")
    per_value = (values.where(~text.is_blank("value")).groupBy(*keys, F.lower("value").alias("_low")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("at"), "value")).alias("first")))
    # lower-casing merges spellings whose numbers may differ ("1K" and "1k"): numbers are summed per exact value
    exact = (values.where(~text.is_blank("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("plain", plain).withColumn("mbps", mbps)
             .withColumn("_unit", numbers.unit_letter("value").isin("G", "M", "T", "K"))
             .groupBy(*keys).agg(*[f for k in ("plain", "mbps") for f in (
                 F.sum(F.when(F.col(k).isNotNull(), F.col("n"))).alias(f"{k}_n"),
                 F.sum(F.col(k) * F.col("n")).alias(f"{k}_sum"), F.max(k).alias(f"{k}_max"), F.min(k).alias(f"{k}_min"))],
                 F.bool_or("_unit").alias("has_unit")))
    counts = per_value.groupBy(*keys).agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_n"))
    first = (top_per_group(per_value.select(*keys, "first"), keys, [F.col("first")], options.first_values, "_r")
             .groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["value"]), ",")
                                 .alias("first_values")))
    return counts.join(exact, keys).join(first, keys)


# ── answer rows ───────────────────────────────────────────────────────────────


def answer_rows(df: DataFrame, extractor: str, **fields: Column | str | int | bool | float | None) -> DataFrame:
    """Answers in the common form, from questions joined to their set's totals; fields that are not given have defaults."""
    order, (version, priority) = list(_REGISTRY).index(extractor), (_REGISTRY[extractor].version, _REGISTRY[extractor].priority)
    given = {"confidence": 100.0, "column_used": None, "sheet_name": None, "is_exact": True, "column_matched": True,
             "fallback_extractor": None, "values_extracted": 0, "distinct_values": 0, "rejected_rows": 0,
             "first_values": None, **fields, "rows_processed": F.col("total_rows"), "extractor_name": extractor,
             "extractor_version": version, "extractor_priority": priority, "extractor_order": order}
    types = {"confidence": "double", "rows_processed": "bigint", "values_extracted": "bigint", "distinct_values": "bigint",
             "rejected_rows": "bigint", "extractor_priority": "int", "extractor_order": "int", "is_exact": "boolean",
             "column_matched": "boolean"}
    cols = ["query_id", "doc_set_id"]
    for name in ANSWER[2:]:
        v = given[name]
        v = v if isinstance(v, Column) else F.lit(v)
        cols.append(v.cast(types.get(name, "string")).alias(name))
    return df.select(*cols)


def _method(verb: str | Column, column: str = "col_name") -> Column:
    verb = verb if isinstance(verb, Column) else F.lit(verb)
    return F.concat(verb, F.lit("("), names.canonical_column(column), F.lit(")"))


def _verb() -> Column:
    return (F.when(F.col("intent") == "DistinctCount", "Distinct").when(F.col("intent") == "Count", "Count")
            .when(F.col("intent") == "Sum", "Sum").when(F.col("intent") == "Average", "Average")
            .when(F.col("intent") == "Maximum", "Max").when(F.col("intent") == "Minimum", "Min"))


def count_row_answers(eligible: DataFrame, totals: DataFrame) -> DataFrame:
    asked = eligible.where((F.col("extractor") == "GenericColumn") & F.col("intent").isin("Count", "Aggregation"))
    return answer_rows(asked.join(totals, "doc_set_id"), "GenericColumn", value=F.col("total_rows").cast("string"),
                    method="Count(rows)", column_matched=False, sheet_name=F.col("only_sheet"))


def _fallback_columns(headers: DataFrame) -> DataFrame:
    """Extra column names the circuit, interface and address extractors accept, first in table order."""
    low = F.lower(text.strip("col_name"))
    spaced = F.lower(text.strip(F.translate("col_name", "_-", "  ")))
    offers = F.array_compact(F.array(
        F.when(spaced.isin(vocab.CIRCUIT_COLUMNS), F.lit("CircuitExtractor")),
        F.when(low.isin(vocab.INTERFACE_COLUMNS), F.lit("InterfaceExtractor")),
        F.when(low.isin(vocab.IP_COLUMNS), F.lit("IpAddressExtractor"))))
    return (headers.where(~text.is_blank("col_name")).withColumn("extractor", F.explode(offers))
            .groupBy("doc_set_id", "extractor").agg(F.min(F.struct("sheet_no", "col_no", "col_name")).alias("s"))
            .select("doc_set_id", "extractor", F.col("s.col_name").alias("_extra")))


def question_columns(eligible: DataFrame, headers: DataFrame) -> DataFrame:
    """Each eligible question and extractor with the column it works on (null: none)."""
    without = [e.name for e in extractors() if not e.needs_column]
    needs = eligible.where(~((F.col("extractor") == "GenericColumn") & F.col("intent").isin("Count", "Aggregation"))
                           & ~F.col("extractor").isin(without))
    asked = needs.select("query_id", "doc_set_id", "query_text").distinct()
    return (needs.join(tb.resolve_target_column(asked, headers), ["query_id", "doc_set_id"], "left")
            .join(_fallback_columns(headers), ["doc_set_id", "extractor"], "left")
            .withColumn("col_name", F.coalesce("col_name", "_extra")).drop("_extra"))


def with_figures(targets: DataFrame, rows: DataFrame, headers: DataFrame, totals: DataFrame,
                 options: Options = DEFAULTS) -> DataFrame:
    """Questions with a column joined to the figures of that column."""
    resolved = targets.where(F.col("col_name").isNotNull())
    places = tb.sheet_columns(resolved, headers)
    figures = column_figures(tb.column_values(places, rows), options)
    return (resolved.withColumn("target", F.lower("col_name")).join(totals, "doc_set_id")
            .join(figures, ["doc_set_id", "target"], "left"))


def column_count_answers(asked: DataFrame, extractor: str) -> DataFrame:
    """Distinct or filled values of a column (circuits, interfaces, addresses, any column)."""
    df = asked.where((F.col("extractor") == extractor) & F.col("intent").isin("Count", "DistinctCount"))
    filled, distinct = F.coalesce("filled", F.lit(0)), F.coalesce("distinct_n", F.lit(0))
    value = F.when(F.col("intent") == "DistinctCount", distinct).otherwise(filled)
    return answer_rows(df, extractor, value=value.cast("string"), method=_method(_verb()), column_used=F.col("col_name"),
                    values_extracted=filled, distinct_values=distinct,
                    first_values=F.coalesce("first_values", F.lit("")))


def _aggregate(reading: str) -> Column:
    """Sum, average, maximum or minimum of a column read as plain numbers or as Mbps."""
    total, n = F.col(f"{reading}_sum"), F.col(f"{reading}_n")
    return (F.when(F.col("intent") == "Sum", total).when(F.col("intent") == "Average", total / n)
            .when(F.col("intent") == "Maximum", F.col(f"{reading}_max"))
            .when(F.col("intent") == "Minimum", F.col(f"{reading}_min")))


def numeric_answers(asked: DataFrame) -> DataFrame:
    df = asked.where((F.col("extractor") == "GenericColumn") & F.col("intent").isin("Sum", "Average", "Maximum", "Minimum"))
    # filtered on the number: a filter on its text would repeat the formatting
    df = df.withColumn("_v", _aggregate("plain")).where(F.col("_v").isNotNull())
    return answer_rows(df, "GenericColumn", value=numbers.format_result("_v"),
                    method=_method(_verb()), column_used=F.col("col_name"))


def bandwidth_answers(asked: DataFrame) -> DataFrame:
    """In Mbps; a column without unit letters uses whichever reading parses more cells."""
    df = asked.where(F.col("extractor") == "BandwidthExtractor")
    plain_n, mbps_n = F.coalesce("plain_n", F.lit(0)), F.coalesce("mbps_n", F.lit(0))
    plain = ~F.coalesce("has_unit", F.lit(False)) & (plain_n > mbps_n)
    df = df.withColumn("_v", F.when(plain, _aggregate("plain")).otherwise(_aggregate("mbps"))).where(F.col("_v").isNotNull())
    return answer_rows(df, "BandwidthExtractor", value=numbers.format_result("_v"), method=_method(_verb()),
                    column_used=F.col("col_name"))


# ── VLAN ──────────────────────────────────────────────────────────────────────


def primary_vlan_tables(sheets: DataFrame) -> DataFrame:
    """Largest table with a VLAN column: doc_set_id, col_name, sheet_no, sheet_name, col_no."""
    heads = sheets.select("doc_set_id", "sheet_no", "sheet_name", "n_rows", F.posexplode("columns").alias("_p", "col_name"))
    flat = names.flatten_name("col_name")
    sub = (F.when(flat == "VLAN", 1).when(names.concept_of("col_name") == "VLAN", 2)
           .when(F.contains(flat, F.lit("VLAN")), 3))
    best = (heads.withColumn("_sub", sub).where(F.col("_sub").isNotNull()).groupBy("doc_set_id").agg(
        F.min(F.struct((-F.col("n_rows")).alias("size"), "sheet_no", "_sub", "_p", "col_name", "sheet_name")).alias("b")))
    chosen = best.select("doc_set_id", F.col("b.sheet_no").alias("sheet_no"), F.col("b.col_name").alias("col_name"),
                         F.col("b.sheet_name").alias("vlan_sheet"))
    first = heads.groupBy("doc_set_id", "sheet_no", F.lower("col_name").alias("_low")).agg(F.min("_p").alias("col_no"))
    return (chosen.withColumn("_low", F.lower("col_name")).join(first, ["doc_set_id", "sheet_no", "_low"]).drop("_low"))


def vlan_answers(eligible: DataFrame, rows: DataFrame, sheets: DataFrame, totals: DataFrame,
                 options: Options = DEFAULTS) -> DataFrame:
    asked = eligible.where(F.col("extractor") == "VlanExtractor")
    primary = primary_vlan_tables(sheets).join(asked.select("doc_set_id").distinct(), "doc_set_id", "left_semi")
    places = primary.select("doc_set_id", F.lit(_VLAN_TARGET).alias("target"), "sheet_no", "col_no")
    figures = column_figures(tb.column_values(places, rows), options).drop("target")
    df = (asked.join(primary.select("doc_set_id", "col_name", "vlan_sheet"), "doc_set_id").join(totals, "doc_set_id")
          .join(figures, "doc_set_id", "left").withColumn("_v", _aggregate("plain")))
    filled, distinct = F.coalesce("filled", F.lit(0)), F.coalesce("distinct_n", F.lit(0))
    is_distinct, is_count = F.col("intent") == "DistinctCount", F.col("intent") == "Count"
    df = df.where(is_distinct | is_count | F.col("_v").isNotNull())
    value = (F.when(is_distinct, distinct.cast("string")).when(is_count, filled.cast("string"))
             .otherwise(numbers.format_result("_v")))
    return answer_rows(df, "VlanExtractor", value=value, column_used=F.col("col_name"),
                    method=F.concat(_method(_verb()), F.lit(" in '"), "vlan_sheet", F.lit("'")),
                    values_extracted=F.when(is_distinct | is_count, filled).otherwise(0),
                    distinct_values=F.when(is_distinct, distinct).otherwise(0),
                    first_values=F.when(is_distinct, F.coalesce("first_values", F.lit(""))))


def vlan_first_token_answers(eligible: DataFrame, rows: DataFrame, sheets: DataFrame, totals: DataFrame,
                             options: Options = DEFAULTS) -> DataFrame:
    """Listings without a VLAN column: a leading number of one to four digits is an id.

    Header cells count too, because a listing's first row was taken for a header.
    """
    low, high = vocab.VLAN_RANGE
    asked = (eligible.where(F.col("extractor") == "VlanExtractor")
             .join(primary_vlan_tables(sheets).select("doc_set_id"), "doc_set_id", "left_anti"))
    token = F.regexp_extract(F.get("cells", F.lit(0)), r"(?U)^\s*([0-9]{1,4})\b", 1).try_cast("int")
    scanned = (rows.join(asked.select("doc_set_id").distinct(), "doc_set_id", "left_semi")
               .select("doc_set_id", F.when(token.between(low, high), token).alias("vlan")))
    per_id = scanned.groupBy("doc_set_id", "vlan").agg(F.count(F.lit(1)).alias("n"))  # at most 4,094 ids and null per set
    found = F.col("vlan").isNotNull()
    figures = per_id.groupBy("doc_set_id").agg(
        F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("extracted"),
        F.coalesce(F.sum(F.when(~found, F.col("n"))), F.lit(0)).alias("rejected"),
        F.count("vlan").alias("ids"), F.max("vlan").alias("hi"), F.min("vlan").alias("lo"),
        F.slice(F.sort_array(F.collect_list("vlan")), 1, options.first_values).alias("firsts")).where(F.col("ids") > 0)
    df = asked.join(totals, "doc_set_id").join(figures, "doc_set_id")
    is_distinct, is_count = F.col("intent") == "DistinctCount", F.col("intent") == "Count"
    value = (F.when(is_distinct, F.col("ids")).when(is_count, F.col("extracted"))
             .when(F.col("intent") == "Maximum", F.col("hi")).otherwise(F.col("lo")))
    method = (F.when(is_distinct, "Distinct(VLAN_ID_FROM_FIRST_TOKEN)").when(is_count, "Count(VLAN_ROWS_FROM_FIRST_TOKEN)")
              .when(F.col("intent") == "Maximum", "Max(VLAN_ID_FROM_FIRST_TOKEN)").otherwise("Min(VLAN_ID_FROM_FIRST_TOKEN)"))
    return answer_rows(df, "VlanExtractor", value=value.cast("string"), method=method, confidence=95.0, is_exact=False,
                    column_matched=False, column_used="VLAN(first-token)", fallback_extractor="VlanFirstToken",
                    values_extracted=F.when(is_distinct | is_count, F.col("extracted")).otherwise(0),
                    distinct_values=F.when(is_distinct, F.col("ids")).otherwise(0),
                    rejected_rows=F.when(is_distinct, F.col("rejected")).otherwise(0),
                    first_values=F.when(is_distinct, F.array_join(F.transform("firsts", lambda x: x.cast("string")), ",")))


# ── content scans ─────────────────────────────────────────────────────────────


def _scan_answers(targets: DataFrame, rows: DataFrame, totals: DataFrame, extractor: str, found: Callable[[Column], Column], label: str,
                  column: str, fallback: str, options: Options) -> DataFrame:
    asked = targets.where((F.col("extractor") == extractor) & F.col("col_name").isNull())
    scanned = (rows.where(~F.col("is_header")).join(asked.select("doc_set_id").distinct(), "doc_set_id", "left_semi")
               .select("doc_set_id", F.struct("sheet_no", "doc_id", "row_no").alias("at"),
                       F.posexplode(F.flatten(F.transform("cells", found))).alias("k", "v")))
    per_value = (scanned.groupBy("doc_set_id", F.lower("v").alias("_low"))
                 .agg(F.min(F.struct("at", "k", "v")).alias("f")).select("doc_set_id", F.col("f.v").alias("v")))
    first = (top_per_group(per_value, ["doc_set_id"], [F.col("v")], options.first_values, "_r").groupBy("doc_set_id")
             .agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("first_values")))
    figures = per_value.groupBy("doc_set_id").agg(F.count(F.lit(1)).alias("n")).join(first, "doc_set_id")
    df = asked.join(totals, "doc_set_id").join(figures, "doc_set_id")
    return answer_rows(df, extractor, value=F.col("n").cast("string"), confidence=95.0,
                    method=F.concat(_verb(), F.lit(f"({label})")), column_used=column, is_exact=False, column_matched=False,
                    fallback_extractor=fallback, distinct_values=F.col("n"), first_values=F.col("first_values"))


def interface_scan_answers(targets: DataFrame, rows: DataFrame, totals: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    def names_in(cell: Column) -> Column:
        trimmed = text.strip(cell)
        return F.when(trimmed.rlike(vocab.INTERFACE_NAME), F.array(trimmed)).otherwise(F.array().cast("array<string>"))
    return _scan_answers(targets, rows, totals, "InterfaceExtractor", names_in, "INTERFACE_FROM_CONTENT",
                         "Interface(content-scan)", "InterfaceContentScan", options)


def ip_scan_answers(targets: DataFrame, rows: DataFrame, totals: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    return _scan_answers(targets, rows, totals, "IpAddressExtractor", text.ipv4_addresses, "IPv4_FROM_CONTENT",
                         "IPv4(content-scan)", "IpContentScan", options)


# ── all together ──────────────────────────────────────────────────────────────


def answer_candidates(queries: DataFrame, rows: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Every extractor's answer to every question.  ``queries``: query_id, doc_set_id, query_text, intent."""
    rows = cut_columns(rows)  # the parsed tables, read by every extractor
    sheets = cut_lineage(tb.sheets_of(rows))
    headers, totals = tb.headers_of(sheets), set_totals(sheets)
    # questions are few next to cells; cut here so that no filter drags the phrase tests along
    eligible = cut_lineage(extractor_eligibility(queries))
    targets = cut_lineage(question_columns(eligible, headers))
    asked = cut_lineage(with_figures(targets, rows, headers, totals, options))
    basis = Basis(rows, sheets, headers, totals, eligible, targets, asked, options)
    return reduce(DataFrame.unionByName, [e.answers(basis).select(*ANSWER) for e in extractors()])


def answer_arbitration(candidates: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One answer per question: confidence, then priority, then values extracted, then extractor order."""
    confident = candidates.where(F.col("confidence") >= options.min_confidence)
    w = Window.partitionBy("query_id", "doc_set_id")
    order = [F.col("confidence").desc(), F.col("extractor_priority").desc(), F.col("values_extracted").desc(),
             F.col("extractor_order")]
    return (confident.withColumn("candidate_count", F.count(F.lit(1)).over(w).cast("int"))
            .withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") == 1)
            .drop("_r", "extractor_order"))


def exact_answers(queries: DataFrame, texts: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Questions that ask for a calculation, answered from the tables of their document sets."""
    asked = cut_lineage(classify(queries)).where(intents.is_structured("intent"))
    return answer_arbitration(answer_candidates(asked, tb.load_tables(texts), options), options)


# ── the built-in extractors ───────────────────────────────────────────────────


def _generic(b: Basis) -> DataFrame:
    distinct = column_count_answers(b.asked.where(F.col("intent") == "DistinctCount"), "GenericColumn")
    return count_row_answers(b.eligible, b.totals).unionByName(numeric_answers(b.asked)).unionByName(distinct)


_ANSWERS: dict[str, Callable[[Basis], DataFrame]] = {
    "VlanExtractor": lambda b: vlan_answers(b.eligible, b.rows, b.sheets, b.totals, b.options).unionByName(
        vlan_first_token_answers(b.eligible, b.rows, b.sheets, b.totals, b.options)),
    "BandwidthExtractor": lambda b: bandwidth_answers(b.asked),
    "CircuitExtractor": lambda b: column_count_answers(b.asked, "CircuitExtractor"),
    "InterfaceExtractor": lambda b: column_count_answers(b.asked, "InterfaceExtractor").unionByName(
        interface_scan_answers(b.targets, b.rows, b.totals, b.options)),
    "IpAddressExtractor": lambda b: column_count_answers(b.asked, "IpAddressExtractor").unionByName(
        ip_scan_answers(b.targets, b.rows, b.totals, b.options)),
    "GenericColumn": _generic,
}
for _name, _version, _priority, _served, _terms in vocab.EXTRACTORS:
    register_extractor(Extractor(_name, _version, _priority, serves(_served, _terms), _ANSWERS[_name], _name != "VlanExtractor"))
