"""One metrics row per question, put together from the results of the answering steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import intents, text
from foliant.plans.scopes import to_questions

METRICS = ["query_id", "intent", "strategy", "documents", "retrieved_chunks", "total_chunks", "source_items", "coverage_percent",
           "total_chars", "chars_sent", "char_percent", "is_truncated", "context_chars", "query_chars", "candidate_models",
           "prompt_augmented", "structured", "answer_method", "answer_value", "answer_rows", "answer_confidence", "answer_column",
           "answer_extractor", "answer_candidates", "top_score", "average_score", "lowest_score", "empty_retrieval"]


def code_counts(scope: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct model codes, case ignored, over the texts (doc_id, text) of each question's documents.

    Codes are found once per document; only the codes are paired with questions.
    """
    found = texts.select("doc_id", F.explode(F.array_distinct(F.transform(text.model_codes("text"), F.upper))).alias("code")).distinct()
    return scope.join(found, "doc_id").groupBy("query_id").agg(F.count_distinct("code").alias("codes"))


def session_metrics(queries: DataFrame, strategies: DataFrame, answers: DataFrame, answer_documents: DataFrame, coverage: DataFrame,
                    retrieved: DataFrame, contexts: DataFrame, text_codes: DataFrame, chunk_codes: DataFrame,
                    asked: DataFrame | None = None) -> DataFrame:
    """Every input has one row per question or is reduced to that here; all joins are on query_id.

    ``answer_documents``: query_id, doc_id of the tables an answer used, with scopes in query_id where ``asked`` (query_id, scope_id) is given; ``coverage``: ``context_coverage``;
    ``retrieved``: query_id, doc_id, score; ``contexts``: query_id, context of the semantic path;
    ``text_codes`` and ``chunk_codes``: query_id, codes.
    """
    hits = retrieved.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_hits"), F.count_distinct("doc_id").alias("_hit_docs"), F.max("score").alias("_top"),
        F.avg("score").alias("_avg"), F.min("score").alias("_low"))
    used = to_questions(answer_documents.groupBy("query_id").agg(F.count_distinct("doc_id").alias("_used")), asked, many=False)
    answer = answers.select("query_id", "method", "value", "rows_processed", "confidence", "column_used", "extractor_name", "candidate_count")
    joined = (strategies.join(queries.select("query_id", F.length("query_text").alias("query_chars")), "query_id")
              .join(answer, "query_id", "left").join(used, "query_id", "left")
              .join(coverage.withColumnRenamed("documents", "_cover_docs").withColumnRenamed("total_chars", "_cover_chars")
                    .withColumnRenamed("is_truncated", "_cut").withColumnRenamed("context_chars", "_cover_context")
                    .withColumnRenamed("chars_sent", "_cover_sent").withColumnRenamed("char_percent", "_cover_share"), "query_id", "left")
              .join(hits, "query_id", "left")
              .join(contexts.select("query_id", F.length("context").alias("_context")), "query_id", "left")
              .join(text_codes.withColumnRenamed("codes", "_text_codes"), "query_id", "left")
              .join(chunk_codes.withColumnRenamed("codes", "_chunk_codes"), "query_id", "left"))
    structured, small, full, semantic = (F.col("strategy") == s for s in (
        "StructuredDataEngine", "SmallDocumentDirectContext", "FullDocumentRetrieval", "SemanticRetrieval"))

    def by_path(*cases: tuple[Column, Column | str], default: Column | None = None) -> Column:
        chain = None
        for test, value in cases:
            value = F.coalesce(F.col(value), F.lit(0)) if isinstance(value, str) else value
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain.otherwise(F.lit(0) if default is None else default)

    none = F.lit(None)
    listing = intents.is_enumeration("intent")
    codes = by_path((small & listing, "_text_codes"), (full & listing, "_chunk_codes")).cast("bigint")
    whole = F.lit(0.0)
    out = joined.select(
        "query_id", "intent", "strategy",
        by_path((structured, "_used"), (small, "documents"), (full, "_cover_docs"), (semantic, "_hit_docs")).cast("bigint").alias("documents"),
        by_path((full, "chunks_sent"), (semantic, "_hits")).cast("bigint").alias("retrieved_chunks"),
        by_path((full, "total_chunks")).cast("bigint").alias("total_chunks"), by_path((full, "source_rows")).cast("bigint").alias("source_items"),
        F.when(small, 100.0).when(full, F.coalesce("chunk_percent", whole)).otherwise(whole).alias("coverage_percent"),
        by_path((full, "_cover_chars")).cast("bigint").alias("total_chars"), by_path((full, "_cover_sent")).cast("bigint").alias("chars_sent"),
        F.when(full, F.coalesce("_cover_share", whole)).otherwise(whole).alias("char_percent"),
        (full & F.coalesce("_cut", F.lit(False))).alias("is_truncated"),
        by_path((small, "total_chars"), (full, "_cover_context"), (semantic, "_context")).cast("bigint").alias("context_chars"),
        "query_chars", codes.alias("candidate_models"), (codes > 0).alias("prompt_augmented"), structured.alias("structured"),
        *[F.when(structured, F.col(c)).otherwise(none).alias(a) for c, a in (
            ("method", "answer_method"), ("value", "answer_value"), ("rows_processed", "answer_rows"), ("confidence", "answer_confidence"),
            ("column_used", "answer_column"), ("extractor_name", "answer_extractor"), ("candidate_count", "answer_candidates"))],
        F.when(semantic, F.col("_top")).alias("top_score"), F.when(semantic, F.col("_avg")).alias("average_score"),
        F.when(semantic, F.col("_low")).alias("lowest_score"), (semantic & F.col("_hits").isNull()).alias("empty_retrieval"))
    return out.select(*METRICS)
