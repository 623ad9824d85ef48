"""Registered queries of the training-text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.collocations import mine_collocations
from foliant.llm.jaccard import jaccard_components
from foliant.llm.licenses import scan_licences
from foliant.llm.oracles import COLLOCATIONS, VECTOR_TOPK
from foliant.llm.packing import pack_documents
from foliant.llm.pieces import encode_decode
from foliant.llm.repetition import repetition_rules
from foliant.llm.secrets import scan_secrets
from foliant.llm.sharding import shard_documents
from foliant.llm.token_counts import count_tokens
from foliant.llm.toxicity import fit_toxicity, toxicity_scores
from foliant.llm.vector_dedup import near_duplicate_vectors
from foliant.llm.vector_topk import top_vectors
from foliant.llm.whitening import whiten

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files: each source is a tree of folders of twenty, whose first document is its licence file."""
    name = F.when(F.col("doc_id") % 20 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat(F.lit("d"), (F.floor(F.col("doc_id") / 400)).cast("string"))
    deep = F.when(F.col("doc_id") % 3 == 0, folder).otherwise(F.concat(folder, F.lit("/sub")))
    return docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", deep, name).alias("path"), "text")


def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_files(_documents(spark, sf_dir))).withColumnRenamed("file", "doc_id")


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity_scores(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_vectors(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition_rules": lambda spark, d: repetition_rules(_documents(spark, d)),
    "op2_splitter_shards": lambda spark, d: shard_documents(_documents(spark, d)),
    "op3_near_duplicate_vectors": lambda spark, d: near_duplicate_vectors(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op4_jaccard_join": lambda spark, d: jaccard_components(_documents(spark, d)),
    "op5_toxicity": _toxicity,
    "op6_token_counts": lambda spark, d: count_tokens(_documents(spark, d), PIECES),
    "op7_piece_ids": lambda spark, d: encode_decode(_documents(spark, d), PIECES),
    "op8_licences": _licences,
    "op9_packing": lambda spark, d: pack_documents(_documents(spark, d), WORDS),
    "op10_secrets": lambda spark, d: scan_secrets(_documents(spark, d)),
    "op11_vector_topk": _vector_topk,
    "op12_collocations": lambda spark, d: mine_collocations(_documents(spark, d)),
    "op13_whitening": lambda spark, d: whiten(spark.read.parquet(f"{d}/embeddings.parquet")),
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {"op11_vector_topk": VECTOR_TOPK, "op12_collocations": COLLOCATIONS}
