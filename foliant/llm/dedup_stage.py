"""One document of each near-duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import stage
from foliant.llm.jaccard import jaccard_components


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the near-duplicates of an earlier id.

    Where ids repeat or are missing, rows are told apart by their place in the order of ids (null ids
    last), so a row goes only if its own text belongs to a group with an earlier row; of rows with one
    id and one text, or without an id and with one text, one stays.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        found = stage(jaccard_components(docs))
        return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    placed = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    rows = stage(placed.withColumn("_row", F.monotonically_increasing_id()))
    found = stage(jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text")))
    first = rows.groupBy("doc_id", F.xxhash64("text"), F.octet_length("text"), F.crc32("text")).agg(F.min("_row").alias("_row")).select("_row")
    kept = rows.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "_row", "left_anti")
    return kept.join(first, "_row", "left_semi").select(*docs.columns)
