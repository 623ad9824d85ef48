"""How much of a document reached the answer, and what an answer should have listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import numbers, text
from foliant.plans.ranking import bucketed_rank, order_buckets
from foliant.plans.scopes import to_questions
from foliant.session import cut_lineage


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, at most 100; an empty whole counts as fully covered."""
    share = numbers.half_even(F.least(F.lit(100.0), part / whole * 100.0), 1)
    return F.when(whole > 0, share).otherwise(F.lit(100.0))


def item_coverage(df: DataFrame, source: str = "source_items", returned: str = "returned_items") -> DataFrame:
    share = percent(F.col(returned), F.col(source))
    known = F.col(source) > 0
    return (df.withColumn("coverage_percent", F.when(known, share).otherwise(F.lit(0.0)))
            .withColumn("status", F.when(~known, "N/A").when(F.col("coverage_percent") >= 100.0, "PASS")
                        .when(F.col("coverage_percent") >= 95.0, "WARNING").otherwise("FAILED"))
            .withColumn("passed", ~known | (F.col("coverage_percent") >= 95.0)))


def document_coverage(df: DataFrame) -> DataFrame:
    """From total_chunks, chunks_sent, total_chars, chars_sent."""
    share = percent(F.col("chunks_sent"), F.col("total_chunks"))
    return (df.withColumn("coverage_percent", share).withColumn("chunk_coverage_percent", share)
            .withColumn("is_truncated", F.col("chunks_sent") < F.col("total_chunks")))


def context_coverage(sizes: DataFrame, sent: DataFrame, context: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Share of chunks and characters an ordered context carries.

    ``sizes``: all chunks of a question (query_id, doc_id, chars, table_rows); ``sent``: those that
    fit; ``context``: query_id, context, chunks_sent.  With ``asked`` (query_id, scope_id) they hold scopes in query_id,
    and the figures of a scope go to its questions.
    """
    totals = sizes.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("chars").alias("total_chars"), F.count_distinct("doc_id").alias("documents"))
    rows = sent.groupBy("query_id").agg(F.sum("table_rows").alias("source_rows"))
    lengths = context.select("query_id", "chunks_sent", F.length("context").cast("bigint").alias("context_chars"))
    totals, lengths, rows = (to_questions(x, asked, many=False) for x in (totals, lengths, rows))
    joined = totals.join(lengths, "query_id", "left").join(rows, "query_id", "left")
    chunks_sent, size = F.coalesce("chunks_sent", F.lit(0)), F.coalesce("context_chars", F.lit(0))
    chars_sent = F.least(size, F.col("total_chars"))
    return joined.select(
        "query_id", "documents", "total_chunks", chunks_sent.alias("chunks_sent"), "total_chars",
        chars_sent.alias("chars_sent"), size.alias("context_chars"), F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        percent(chunks_sent, F.col("total_chunks")).alias("chunk_percent"),
        percent(chars_sent, F.col("total_chars")).alias("char_percent"),
        (chunks_sent < F.col("total_chunks")).alias("is_truncated"))


def model_code_candidates(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct model codes per key in alphabetical order, case ignored: keys, code, rank.

    A key with very many codes is ranked in buckets of the alphabet that its own codes decide.
    """
    return ranked_codes(texts.select(*keys, F.explode(F.array_distinct(text.model_codes("text"))).alias("code")), keys)


def ranked_codes(found: DataFrame, keys: list[str]) -> DataFrame:
    """The same from codes found: keys, code."""
    one = cut_lineage(found.groupBy(*keys, F.upper("code").alias("_up")).agg(F.min("code").alias("code")))
    placed = order_buckets(one, keys, "_up")
    return bucketed_rank(placed, keys, {"_b": F.col("_bucket")}, [F.col("_up")], "rank").select(*keys, "code", F.col("rank").cast("int").alias("rank"))


def verification_gap(source: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that list fewer items than their source has rows (both per query_id)."""
    return (source.join(answers, "query_id")
            .where((F.col("source_rows") > 0) & (F.col("answer_items") < F.col("source_rows"))))
