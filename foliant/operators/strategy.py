"""What to do with a question: wait, calculate, send whole texts, or search.

With ``asked`` (query_id, scope_id) a scope holds scope ids in query_id, and what is found for a scope goes to its questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant import vocab
from foliant.functions import intents
from foliant.options import DEFAULTS, Options
from foliant.plans.ranking import join_text, text_parts
from foliant.plans.scopes import per_question
from foliant.session import cut_lineage

SETTLED = ["Ready", "Blocked", "Failed"]


def ready_texts(scope: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, title, document_type, text of Ready documents that have text."""
    usable = docs.where((F.col("status") == "Ready") & F.col("extracted_text").isNotNull())
    return scope.join(usable.select("doc_id", "title", "document_type", F.col("extracted_text").alias("text")), "doc_id")


def ready_sizes(scope: DataFrame, docs: DataFrame) -> DataFrame:
    """The same documents with their number of characters in place of text: query_id, doc_id, title, document_type, chars."""
    usable = docs.where((F.col("status") == "Ready") & F.col("extracted_text").isNotNull())
    return scope.join(usable.select("doc_id", "title", "document_type", F.length("extracted_text").alias("chars")), "doc_id")


def document_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text of Ready documents, once each, for operators that decide on sizes first."""
    return docs.where((F.col("status") == "Ready") & F.col("extracted_text").isNotNull()).select("doc_id", F.col("extracted_text").alias("text"))


def ready_scope_texts(scope: DataFrame, docs: DataFrame) -> DataFrame:
    """Ready documents with text that any question has in scope, once each."""
    usable = docs.where((F.col("status") == "Ready") & F.col("extracted_text").isNotNull())
    return (usable.select("doc_id", "title", "document_type", F.col("extracted_text").alias("text"))
            .join(scope.select("doc_id").distinct(), "doc_id", "left_semi"))


def _pending_line() -> Column:
    return F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("processing_stage", "status"), F.coalesce(F.concat(
        F.lit(" "), F.col("progress_current").cast("string"), F.lit("/"), F.col("progress_total").cast("string")), F.lit("")))


def pending_parts(scope: DataFrame, docs: DataFrame, part_chars: int = DEFAULTS.max_context_chars) -> DataFrame:
    """The lines about a question's pending documents as parts of about ``part_chars`` characters: query_id, part_no, text.

    A question may wait for any number of documents; here no string grows with that number.
    """
    d = scope.join(docs.where(~F.col("status").isin(SETTLED)).select(
        "doc_id", "title", "status", "processing_stage", "progress_current", "progress_total"), "doc_id")
    lines = cut_lineage(d.select("query_id", "doc_id", F.concat(_pending_line(), F.lit("\n")).alias("piece")))
    return text_parts(lines, ["query_id"], "doc_id", "piece", part_chars)


def processing_guard(queries: DataFrame, scope: DataFrame, docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Documents of a question that are still being processed, and the prompt that says so."""
    d = scope.join(docs.select("doc_id", "title", "status", "processing_stage", "progress_current", "progress_total"), "doc_id")
    pending = ~F.col("status").isin(SETTLED)
    per = (d.withColumn("_line", F.when(pending, _pending_line())).groupBy("query_id").agg(
        F.count_if(pending).alias("pending"), F.count_if(F.col("status") == "Ready").alias("ready"),
        join_text("_line", "doc_id", "\n").alias("_lines")))
    none = F.coalesce("pending", F.lit(0)) == 0
    block = F.concat(F.lit("\n\n" + vocab.PENDING_HEAD), "_lines", F.lit(vocab.PENDING_TAIL))
    return per_question(queries, per, asked, "left").select(
        "query_id", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("ready", F.lit(0)).alias("ready"),
        (~none & (F.coalesce("ready", F.lit(0)) == 0)).alias("short_circuit"),
        F.when(none, F.col("query_text")).otherwise(F.concat("query_text", block)).alias("prompt"))


def choose_strategy(queries: DataFrame, scope: DataFrame, docs: DataFrame, answers: DataFrame,
                    options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """Strategy per question.  ``queries`` carry intent; ``answers``: query_id of exact answers.

    Text lengths decide, so only lengths are aggregated here, never texts.
    """
    size = F.length("extracted_text")
    usable = docs.where((F.col("status") == "Ready") & F.col("extracted_text").isNotNull()).select("doc_id", size.alias("chars"))
    sizes = scope.join(usable, "doc_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("total_chars"),
        F.bool_and(F.col("chars").between(1, options.small_document_chars)).alias("_small"))
    guard = processing_guard(queries, scope, docs, asked).select("query_id", "short_circuit")
    solved = answers.select("query_id").distinct().withColumn("_solved", F.lit(True))
    joined = per_question(queries.select("query_id", "intent").join(guard, "query_id"), sizes, asked, "left").join(solved, "query_id", "left")
    return joined.select("query_id", "intent", _strategy(options).alias("strategy"),
                         F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"))


def _strategy(options: Options) -> Column:
    return (F.when(F.col("short_circuit"), "StillProcessing")
            .when(F.col("_solved") & intents.is_structured("intent"), "StructuredDataEngine")
            .when(F.lit(options.small_document_chars > 0) & F.coalesce(F.col("_small"), F.lit(False)), "SmallDocumentDirectContext")
            .when(intents.needs_full_document("intent"), "FullDocumentRetrieval").otherwise("SemanticRetrieval"))
