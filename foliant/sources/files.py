"""Text files and stored vectors as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant import vocab
from foliant.functions import kinds
from foliant.functions.text import col


def decode_text(content: Column | str, strip_bom: Column | bool = False) -> Column:
    """UTF-8 bytes to text with replacement characters for invalid bytes."""
    text = F.make_valid_utf8(col(content).cast("string"))
    bare = F.regexp_replace(text, "^﻿", "")
    return F.when(strip_bom, bare).otherwise(text) if isinstance(strip_bom, Column) else (bare if strip_bom else text)


def read_text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per readable text, code, CSV or Markdown file: path, file_name, extension, document_type, text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    files = reader.load(path).select("path", name.alias("file_name"), extension.alias("extension"), "content")
    plain = F.col("extension").isin(vocab.READABLE_TEXT_EXTENSIONS)
    readable = files.where(plain | F.col("extension").isin(vocab.PLAIN_TEXT_EXTENSIONS))
    return readable.select("path", "file_name", "extension",
                           kinds.route_document_type("extension", F.lit(None).cast("string")).alias("document_type"),
                           decode_text("content", plain).alias("text"))


def read_vector_json(df: DataFrame, column: str = "vector_json") -> DataFrame:
    """Parse vectors stored as JSON text; rows that do not parse are skipped."""
    return (df.withColumn("vector", F.from_json(column, "array<float>"))
            .where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).drop(column))
