"""The vector index as a table: points per index, with payload.

points: index_name, point_id, doc_id, vector, collection_ids, allowed_group_ids, …
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.functions.text import col, is_blank
from foliant.options import DEFAULTS


def index_name(provider: Column | str, model: Column | str, prefix: str = DEFAULTS.index_prefix) -> Column:
    raw = F.concat_ws("_", F.lit(prefix), F.coalesce(col(provider), F.lit("")), F.coalesce(col(model), F.lit("")))
    return F.regexp_replace(F.lower(raw), "[^a-z0-9_]", "_")


def index_dimension_check(expected: DataFrame, points: DataFrame) -> DataFrame:
    """Created, Existing or DimensionMismatch per expected index (index_name, dimensions)."""
    present = points.groupBy("index_name").agg(F.max(F.size("vector")).alias("existing"))
    return expected.join(present, "index_name", "left").select(
        "index_name", "dimensions", F.when(F.col("existing").isNull(), "Created")
        .when((F.col("existing") != 0) & (F.col("existing") != F.col("dimensions")), "DimensionMismatch")
        .otherwise("Existing").alias("state"))


def index_upsert(points: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by point id within an index."""
    kept = points.join(incoming.select("index_name", "point_id"), ["index_name", "point_id"], "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def index_delete_by_document(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop every point of the given documents (doc_id, or index_name and doc_id)."""
    keys = [c for c in ("index_name", "doc_id") if c in documents.columns]
    return points.join(documents.select(*keys), keys, "left_anti")


def index_set_collections(points: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace both list fields on all points of updated documents (doc_id, collection_ids, allowed_group_ids)."""
    new = updates.select("doc_id", F.struct("collection_ids", "allowed_group_ids").alias("_new"))
    joined = points.join(new, "doc_id", "left")
    for name in ("collection_ids", "allowed_group_ids"):
        joined = joined.withColumn(name, F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)))
    return joined.drop("_new").select(*points.columns)


_PAYLOAD = ("document_chunk_id string, document_id string, user_id string, file_id string, file_name string, document_title string, "
            "chunk_index int, page_number int, heading string, embedding_model string, embedding_provider string, "
            "content_preview string, collection_ids string, allowed_group_ids string")


def string_list(raw: Column | str) -> Column:
    """A JSON array or a comma-separated string as a list without blanks; null when nothing is left."""
    raw = col(raw)
    items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ",", -1))
    kept = F.filter(items, lambda x: ~is_blank(x))
    return F.when(F.size(kept) > 0, kept)


def index_payload_read(hits: DataFrame, column: str = "payload", id_type: str = "bigint") -> DataFrame:
    """Typed payload of index hits; hits without a chunk and document id of ``id_type`` (bigint or string) are dropped."""
    p = hits.withColumn("_p", F.from_json(column, _PAYLOAD)).drop(column)
    ids = p.withColumn("chunk_id", F.col("_p.document_chunk_id").try_cast(id_type)).withColumn(
        "doc_id", F.col("_p.document_id").try_cast(id_type)).where(F.col("chunk_id").isNotNull() & F.col("doc_id").isNotNull())
    texts = [F.coalesce(f"_p.{c}", F.lit("")).alias(c) for c in (
        "file_name", "document_title", "embedding_model", "embedding_provider", "content_preview")]
    return ids.select(*[c for c in hits.columns if c != column], "chunk_id", "doc_id",
                      F.col("_p.user_id").try_cast(id_type).alias("user_id"), F.col("_p.file_id").try_cast(id_type).alias("file_id"), *texts,
                      F.coalesce("_p.chunk_index", F.lit(0)).alias("chunk_index"), "_p.page_number", "_p.heading",
                      string_list("_p.collection_ids").alias("collection_ids"),
                      string_list("_p.allowed_group_ids").alias("allowed_group_ids"))


# ── stored form ───────────────────────────────────────────────────────────────
# A change V writes what it adds (points/version=V) and the documents whose older points it ends (ended/version=V);
# a base V (bases/version=V) holds the whole index as of change V.  A row in changes/version=V or done/version=V, written
# last, makes it count.  No file is ever rewritten: a base only spares its readers the changes before it.

#: Bytes of points in a file of a base.
FILE_BYTES = 128 << 20
#: Changes after which a new base is due.
CHANGES_PER_BASE = 16


def _known(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """Versions that count; None where nothing was written yet."""
    try:
        return spark.read.schema("ok boolean, version int").parquet(f"{path}/{table}").select("version")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _versions(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base and the changes after it."""
    done, changes = _known(spark, path, "done"), _known(spark, path, "changes")
    base = None if done is None else done.agg(F.max("version").alias("v")).first()["v"]
    if changes is not None and base is not None:
        changes = changes.where(F.col("version") > base)
    return base, [] if changes is None else sorted(r["version"] for r in changes.distinct().collect())


def _write(df: DataFrame, path: str, table: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{table}/version={version}")


def _count_in(spark: SparkSession, path: str, table: str, version: int) -> None:
    _write(spark.range(1).select(F.lit(True).alias("ok")).coalesce(1), path, table, version)


def _next(spark: SparkSession, path: str) -> int:
    base, changes = _versions(spark, path)
    return max([-1 if base is None else base, *changes]) + 1


def change_points(spark: SparkSession, path: str, incoming: DataFrame, ended: DataFrame | None = None, version: int | None = None) -> int:
    """One change: the older points of documents (index_name, doc_id) end, and the incoming ones are added.

    Without ``ended`` the documents of the incoming points are re-indexed.  Only new files are written, in the
    size of the change; the same version again overwrites itself, so a replayed batch counts once.
    """
    version = _next(spark, path) if version is None else version
    ended = incoming if ended is None else ended
    _write(incoming, path, "points", version)
    _write(ended.select("index_name", "doc_id").distinct(), path, "ended", version)
    _count_in(spark, path, "changes", version)
    return version


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """The live points: of the newest base and the changes after it, without those that a later change ended."""
    base, changes = _versions(spark, path)
    parts = [] if base is None else [spark.read.parquet(f"{path}/bases/version={base}").withColumn("_version", F.lit(base))]
    if changes:
        added = spark.read.option("basePath", f"{path}/points").option("mergeSchema", True).parquet(*[f"{path}/points/version={v}" for v in changes])
        parts.append(added.withColumnRenamed("version", "_version"))
    if not parts:
        raise ValueError(f"no index in {path}")
    points = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    if changes:
        ended = spark.read.option("basePath", f"{path}/ended").parquet(*[f"{path}/ended/version={v}" for v in changes])
        last = ended.groupBy("index_name", "doc_id").agg(F.max("version").alias("_ended"))
        points = points.join(last, ["index_name", "doc_id"], "left").where(F.col("_ended").isNull() | (F.col("_version") >= F.col("_ended"))).drop("_ended")
    return points.drop("_version")


def _write_base(points: DataFrame, path: str, version: int) -> None:
    """Files of about FILE_BYTES, a document's points together: reads of few documents skip most row groups."""
    size = points.agg(F.sum(F.size("vector").cast("long") * 4 + 400).alias("bytes")).first()["bytes"] or 0
    files = max(1, -(-size // FILE_BYTES))
    _write(points.repartition(files, "index_name", "doc_id").sortWithinPartitions("index_name", "doc_id"), path, "bases", version)
    _count_in(points.sparkSession, path, "done", version)


def save_points(points: DataFrame, path: str) -> None:
    """Write a whole index; an older one in the same place ends."""
    _write_base(points, path, _next(points.sparkSession, path))


def compact_points(spark: SparkSession, path: str, least_changes: int = CHANGES_PER_BASE) -> bool:
    """Write a new base once there are so many changes; older files stay until someone removes them."""
    _, changes = _versions(spark, path)
    if len(changes) < max(1, least_changes):
        return False
    _write_base(load_points(spark, path), path, changes[-1])
    return True


def replace_documents(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Re-index documents: their old points end and the new ones are added, in new files only."""
    change_points(spark, path, incoming)
