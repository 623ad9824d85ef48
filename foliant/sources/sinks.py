"""Rows written after embedding and after each model request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.functions import text
from foliant.operators.operations import request_cost
from foliant.options import DEFAULTS, Options


def embedding_sink(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Stored vectors of chunks: chunks joined to vectors by (doc_id, chunk_index), empty vectors skipped."""
    made = embeddings.where(F.size("vector") > 0).select("doc_id", "chunk_index", "vector")
    return (chunks.select("doc_id", "chunk_index", "chunk_id").join(made, ["doc_id", "chunk_index"])
            .select("chunk_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "vector",
                    F.size("vector").alias("dimensions")))


def request_log_rows(entries: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Log rows with cost; a retry count of zero is stored as null.

    ``entries`` carry tokens, prices (null where the model is unknown), capability and ``priced``.
    """
    out = (entries.withColumn("cost_usd", request_cost("capability", F.col("priced")))
           .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
           .withColumn("retry_count", F.when(F.col("retry_count") > 0, F.col("retry_count"))))
    for name in ("request_preview", "response_preview"):
        if name in entries.columns:
            out = out.withColumn(name, text.truncate_or_null(name, options.log_preview_chars))
    return out


def append_request_log(rows: DataFrame, path: str) -> None:
    """Append, one folder per day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
