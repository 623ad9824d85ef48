"""Sources, index tables and the ingestion stages, each on a whole slice of jobs or points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.inputs import Tables, register
from catalog.operations import COST
from catalog.sqltext import BLANK
from foliant.operators import operations as op
from foliant.sources import files as fl, index as ix, sinks as sk
from foliant.streaming import ingest as ing

# ── sources ───────────────────────────────────────────────────────────────────
register("read_text_documents",
         lambda t: t.documents.select("doc_id", fl.decode_text(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).alias("text")),
         "SELECT doc_id, text || chr(65533) AS text FROM documents")
register("read_vector_json",
         lambda t: fl.read_vector_json(t.embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 3, F.lit("[0.1,")).otherwise(
             F.to_json("embedding")).alias("vector_json"))).select("vec_id", F.size("vector").alias("dimensions"), F.round(
                 F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")),
         """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total
            FROM embeddings WHERE vec_id % 7 <> 3""")
NAME = "regexp_replace(lower('chunks_' || provider || '_' || model), '[^a-z0-9_]', '_', 'g')"
register("index_name", lambda t: t.vectors.select("chunk_id", ix.index_name("provider", "model").alias("index_name")),
         f"SELECT chunk_id, {NAME} AS index_name FROM vectors", ["vectors"])


def points(t: Tables) -> DataFrame:
    return t.points.select(ix.index_name("provider", "model").alias("index_name"), "point_id", "doc_id", "vector", "chunk_index",
                           F.array("source").alias("collection_ids"), F.lit(None).cast("array<string>").alias("allowed_group_ids"))


POINTS = f"pts AS (SELECT {NAME} AS index_name, point_id, doc_id, vector, chunk_index, source FROM points)"
P = ["points"]
register("index_dimension_check",
         lambda t: ix.index_dimension_check(t.vectors.groupBy(ix.index_name(F.concat("provider", F.when(F.col("chunk_id") % 3 == 0, "x").otherwise("")), "model")
                                                              .alias("index_name")).agg((F.max(F.size("vector")) + F.min(F.col("chunk_id") % 2).cast("int")).alias("dimensions")), points(t)),
         f"""SELECT e.index_name, e.dimensions, CASE WHEN p.n IS NULL THEN 'Created' WHEN p.n <> e.dimensions AND p.n <> 0 THEN 'DimensionMismatch' ELSE 'Existing' END AS state
             FROM (SELECT {NAME.replace("provider", "provider || CASE WHEN chunk_id % 3 = 0 THEN 'x' ELSE '' END")} AS index_name,
               CAST(max(len(vector)) + min(chunk_id % 2) AS INTEGER) AS dimensions FROM vectors GROUP BY 1) e
             LEFT JOIN (SELECT index_name, max(len(vector)) AS n FROM pts GROUP BY index_name) p ON p.index_name = e.index_name""", ["points", "vectors"], POINTS)


def incoming(t: Tables) -> DataFrame:
    """New versions of the points of some sources and points for ids not seen yet."""
    return points(t).where(F.col("collection_ids")[0].isin("src1", "src2", "src3")).select(
        "index_name", F.when(F.col("point_id") % 2 == 0, F.col("point_id")).otherwise(F.col("point_id") + 1000000).alias("point_id"), "doc_id",
        "vector", (F.col("chunk_index") + 100).alias("chunk_index"), "collection_ids", "allowed_group_ids")


INCOMING = """inc AS (SELECT index_name, CASE WHEN point_id % 2 = 0 THEN point_id ELSE point_id + 1000000 END AS point_id, doc_id, chunk_index + 100 AS chunk_index
    FROM pts WHERE source IN ('src1', 'src2', 'src3'))"""
COLS = ["index_name", "point_id", "doc_id", "chunk_index"]
register("index_upsert", lambda t: ix.index_upsert(points(t), incoming(t)).select(*COLS),
         """SELECT index_name, point_id, doc_id, chunk_index FROM pts p WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.index_name = p.index_name AND i.point_id = p.point_id)
            UNION ALL SELECT * FROM inc""", P, POINTS + ",\n" + INCOMING)
register("index_delete_by_document",
         lambda t: ix.index_delete_by_document(points(t), t.docs.where(F.col("status") != "Ready").select("doc_id")).select(*COLS),
         "SELECT index_name, point_id, doc_id, chunk_index FROM pts WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status <> 'Ready')",
         ["points", "docs"], POINTS)
register("index_set_collections",
         lambda t: ix.index_set_collections(points(t), t.docs.where(F.col("document_type") == "Excel").select(
             "doc_id", F.array("title", F.lit("x")).alias("collection_ids"), F.array("document_type").alias("allowed_group_ids"))).select(
                 "point_id", "index_name", F.array_join("collection_ids", ",").alias("collections"), F.array_join("allowed_group_ids", ",").alias("groups")),
         """SELECT point_id, index_name, CASE WHEN d.doc_id IS NOT NULL THEN title || ',x' ELSE source END AS collections,
              CASE WHEN d.doc_id IS NOT NULL THEN document_type END AS groups FROM pts p LEFT JOIN docs d ON d.doc_id = p.doc_id AND d.document_type = 'Excel'""",
         ["points", "docs"], POINTS)
register("index_payload_read",
         lambda t: ix.index_payload_read(t.points.select("point_id", F.concat(
             F.lit('{"document_chunk_id":"'), F.when(F.col("point_id") % 9 == 4, "bad").otherwise(F.col("point_id").cast("string")), F.lit('","document_id":"'),
             F.col("doc_id").cast("string"), F.lit('","chunk_index":'), F.col("chunk_index").cast("string"), F.lit(',"page_number":'),
             F.when(F.col("point_id") % 2 == 0, '"7"').otherwise("7"), F.lit(',"collection_ids":'), F.when(F.col("point_id") % 3 == 0, F.concat(
                 F.lit('["'), "source", F.lit('"," "]'))).when(F.col("point_id") % 3 == 1, F.concat(F.lit('"a, ,'), "source", F.lit('"'))).otherwise(
                     F.lit('[]')), F.lit("}")).alias("payload"))).select("point_id", "chunk_id", "doc_id", "chunk_index", "page_number", "file_name",
                                                                       F.array_join("collection_ids", "¦").alias("collections")),
         """SELECT point_id, point_id AS chunk_id, doc_id, chunk_index, CASE WHEN point_id % 2 = 0 THEN NULL ELSE 7 END AS page_number, '' AS file_name,
              CASE point_id % 3 WHEN 0 THEN source WHEN 1 THEN 'a¦' || source END AS collections FROM points WHERE point_id % 9 <> 4""", P)
register("embedding_sink",
         lambda t: sk.embedding_sink(t.chunks, t.chunks.join(t.embeddings, F.col("chunk_id") == F.col("vec_id")).select(
             "doc_id", "chunk_index", F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("vector")),
             "acme", "embed-small").drop("vector"),
         """SELECT c.chunk_id, 'acme' AS provider, 'embed-small' AS model, CAST(len(embedding) AS INTEGER) AS dimensions FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id
            WHERE vec_id % 5 <> 0""", ["chunks"])
register("request_log_sink",
         lambda t: sk.request_log_rows(t.request_log_in.join(t.models.drop("provider_id", "enabled", "sort_order"), "model_id", "left")
                                       .withColumn("priced", F.col("model_name").isNotNull()).withColumn("request_preview", F.col("body"))).select(
             "request_id", "total_tokens", "retry_count", "request_preview",
             (F.col("cost_usd").cast("decimal(24,12)") * F.lit(10 ** 12).cast("decimal(13,0)")).cast("bigint").alias("cost_pico")),
         f"""SELECT request_id, prompt_tokens + completion_tokens AS total_tokens, CASE WHEN retry_count > 0 THEN retry_count END AS retry_count,
               CASE WHEN body <> '' THEN left(body, 1000) END AS request_preview, CAST({COST} AS BIGINT) AS cost_pico FROM request_log_in r LEFT JOIN models m ON m.model_id = r.model_id""",
         ["request_log_in", "models"])

# ── ingestion stages ──────────────────────────────────────────────────────────
JOBS = """jobs AS (SELECT job_no, CAST(j ->> '$.DocumentId' AS BIGINT) AS doc_id, CAST(j ->> '$.FileId' AS BIGINT) AS file_id, CAST(j ->> '$.UserId' AS BIGINT) AS user_id,
    j ->> '$.FileName' AS file_name, CAST(j ->> '$.Attempt' AS INTEGER) AS attempt, CAST(replace(replace(j ->> '$.QueuedAtUtc', 'T', ' '), 'Z', '') AS TIMESTAMP) AS queued_at
    FROM (SELECT job_no, CASE WHEN json_valid(value) AND value <> 'null' THEN value END AS j FROM job_lines) z WHERE j IS NOT NULL)"""
register("ingest_jobs", lambda t: ing.ingest_jobs(t.job_lines).select("job_no", "doc_id", "file_id", "user_id", "file_name", "attempt",
                                                                    F.date_format("queued_at", "yyyy-MM-dd HH:mm:ss").alias("queued")),
         "SELECT job_no, doc_id, file_id, user_id, file_name, attempt, strftime(queued_at, '%Y-%m-%d %H:%M:%S') AS queued FROM jobs", ["job_lines"], JOBS)
register("dead_letters", lambda t: ing.dead_letters(t.job_lines),
         "SELECT job_no, value FROM job_lines WHERE NOT json_valid(value) OR value = 'null'", ["job_lines"])
OUTCOME = """outcomes AS (SELECT j.*, CASE WHEN s.doc_id IS NULL THEN 'unknown' WHEN s.status = 'Ready' THEN 'ready' WHEN s.status = 'Blocked' THEN 'blocked'
    WHEN s.attempts >= 3 THEN 'exhausted' ELSE 'open' END AS outcome FROM jobs j LEFT JOIN doc_state s ON s.doc_id = j.doc_id)"""


def sorted_jobs(t: Tables) -> DataFrame:
    return ing.idempotency_filter(ing.ingest_jobs(t.job_lines), t.doc_state)


STATE = ["job_lines", "doc_state"]
register("idempotency_filter", lambda t: sorted_jobs(t).select("job_no", "doc_id", "outcome"), "SELECT job_no, doc_id, outcome FROM outcomes", STATE, JOBS + ",\n" + OUTCOME)
register("claim_documents",
         lambda t: ing.claim_documents(sorted_jobs(t), t.doc_state, F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit("w")).select(
             "doc_id", "job_no", "status", "attempts", "lock_id", F.date_format("lock_expires", "yyyy-MM-dd HH:mm:ss").alias("lock_expires")),
         """SELECT o.doc_id, o.job_no, 'Processing' AS status, s.attempts + 1 AS attempts, 'w-' || o.doc_id AS lock_id, '2024-01-15 00:30:00' AS lock_expires FROM (
              SELECT doc_id, arg_min(job_no, (queued_at, job_no)) AS job_no FROM outcomes WHERE outcome = 'open' GROUP BY doc_id) o JOIN doc_state s ON s.doc_id = o.doc_id
            WHERE s.lock_id IS NULL OR s.lock_expires <= TIMESTAMP '2024-01-15 00:00:00'""", STATE, JOBS + ",\n" + OUTCOME)


def verdicts(t: Tables) -> DataFrame:
    return op.guard_verdict(t.doc_state, t.guard_steps, t.guard_verdicts)


def counts(t: Tables) -> DataFrame:
    return t.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


GUARDED = """given AS (SELECT d.doc_id, s.step, s.step_order, v.action, v.reason, v.step IS NULL AS silent FROM doc_state d, guard_steps s LEFT JOIN guard_verdicts v
    ON v.doc_id = d.doc_id AND v.step = s.step WHERE s.enabled),
  stops AS (SELECT doc_id, arg_min(CASE WHEN silent THEN 'Pipeline component returned empty response.' ELSE coalesce(reason, '') END, step_order) AS reason
    FROM given WHERE silent OR action IN ('Block', 'Error') GROUP BY doc_id)"""
register("ingest_transition", lambda t: ing.ingest_transition(t.doc_state, verdicts(t), counts(t)).withColumn("chars", F.length("extracted_text")).drop("extracted_text"),
         f"""SELECT doc_id, status, error_message, CASE WHEN status = 'Blocked' THEN error_message END AS block_reason, CASE WHEN has_file AND status <> 'Blocked' THEN
               CAST(length(extracted_text) AS INTEGER) END AS chars, has_file AND document_type IN ('Excel', 'Csv') AND NOT {BLANK('extracted_text')} AS structured_ready, status = 'Ready' AS index_ready,
               CASE WHEN status = 'Ready' THEN n END AS progress_current, CASE WHEN status = 'Ready' THEN n END AS progress_total, CASE WHEN status = 'Ready' THEN CAST(100.0 AS DOUBLE) END AS progress_percent
             FROM (SELECT d.* EXCLUDE (status), n, CASE WHEN NOT has_file OR {BLANK('extracted_text')} THEN 'Failed' WHEN s.doc_id IS NOT NULL THEN 'Blocked' ELSE 'Ready' END AS status,
               CASE WHEN NOT has_file THEN 'Physical file not found on disk.' WHEN {BLANK('extracted_text')} THEN 'Document contains no readable text.' ELSE s.reason END AS error_message
               FROM doc_state d LEFT JOIN stops s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id) z""",
         ["doc_state", "guard_steps", "guard_verdicts", "chunks"], GUARDED)
register("structured_ready", lambda t: t.doc_state.select("doc_id", ing.structured_ready("document_type", "extracted_text").alias("structured_ready")),
         f"SELECT doc_id, document_type IN ('Excel', 'Csv') AND NOT {BLANK('extracted_text')} AS structured_ready FROM doc_state", ["doc_state"])
register("embed_chunks", lambda t: ing.embed_chunks(t.chunks.select("doc_id", "chunk_index", "content"), ing.hashing_embedder()).select(
    "doc_id", "chunk_index", F.size("vector").alias("dimensions")),
    "SELECT doc_id, chunk_index, CAST(64 AS INTEGER) AS dimensions FROM chunks", ["chunks"])


def letters(batch: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: counts of characters; it refuses texts about one circuit."""
    if any("FNT000007" in x for x in batch):
        raise ValueError("refused")
    return [[float(len(x)), *(float(x.count(c)) for c in "ae ")] for x in batch]


register("embed_failures",
         lambda t: ing.embed_chunks(t.chunks.select("doc_id", "chunk_index", "content"), letters, isolate=True).select(
             "doc_id", "chunk_index", F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",").alias("vector"), "failure"),
         """SELECT doc_id, chunk_index, CASE WHEN bad THEN '' ELSE array_to_string([length(content), length(content) - length(replace(content, 'a', '')),
              length(content) - length(replace(content, 'e', '')), length(content) - length(replace(content, ' ', ''))], ',') END AS vector,
              CASE WHEN bad THEN 'ValueError: refused' END AS failure FROM (SELECT *, contains(content, 'FNT000007') AS bad FROM chunks) c""", ["chunks"])


def outcomes(t: Tables) -> DataFrame:
    """Documents as they leave a batch: judged by the guard, embedded unless their number says otherwise."""
    made = ing.ingest_transition(t.doc_state, verdicts(t), counts(t)).select("doc_id", "status", "error_message")
    passed = verdicts(t).select("doc_id", "should_continue")
    return (t.doc_state.select("doc_id", "has_file", F.trim("extracted_text").alias("_text")).join(made, "doc_id").join(passed, "doc_id").join(counts(t), "doc_id", "left")
            .select("doc_id", "has_file", (F.col("has_file") & F.col("should_continue") & (F.col("_text") != "")).alias("passed"), F.lit(True).alias("embedded"),
                    F.coalesce("chunks", F.lit(0)).alias("chunks"), "status", "error_message"))


register("stage_changes", lambda t: ing.stage_changes(outcomes(t)),
         f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS step, status, stage, current, total,
               CASE WHEN total > 0 THEN round_even(current / total * 100, 1) ELSE 0.0 END AS percent, CASE WHEN place = 5 THEN error_message END AS error_message
             FROM (SELECT doc_id, error_message, unnest([{{'place': 1, 'status': 'Extracting', 'stage': 'Extracting', 'current': 0::BIGINT, 'total': 0::BIGINT, 'there': has_file}},
               {{'place': 2, 'status': 'Chunking', 'stage': 'Chunking', 'current': 0, 'total': 0, 'there': passed}}, {{'place': 3, 'status': 'Embedding', 'stage': 'Embedding', 'current': 0, 'total': n, 'there': passed}},
               {{'place': 4, 'status': 'Indexing', 'stage': 'Indexing', 'current': n, 'total': n, 'there': passed}}, {{'place': 5, 'status': final, 'stage': CASE WHEN final = 'Ready' THEN 'Ready'
                 WHEN passed THEN 'Indexing' WHEN has_file THEN 'Extracting' ELSE final END, 'current': CASE WHEN passed THEN n ELSE 0 END, 'total': CASE WHEN passed THEN n ELSE 0 END, 'there': true}}], recursive := true)
               FROM (SELECT d.doc_id, has_file, has_file AND s.doc_id IS NULL AND NOT {BLANK('extracted_text')} AS passed, coalesce(n, 0) AS n,
                 CASE WHEN NOT has_file OR {BLANK('extracted_text')} THEN 'Failed' WHEN s.doc_id IS NOT NULL THEN 'Blocked' ELSE 'Ready' END AS final,
                 CASE WHEN NOT has_file THEN 'Physical file not found on disk.' WHEN {BLANK('extracted_text')} THEN 'Document contains no readable text.' ELSE s.reason END AS error_message
                 FROM doc_state d LEFT JOIN stops s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id) z) s
             WHERE there""",
         ["doc_state", "guard_steps", "guard_verdicts", "chunks"], GUARDED)
register("ingest_progress",
         lambda t: ing.ingest_progress(t.chunks, t.chunks.join(t.vectors, "chunk_id"), t.doc_state),
         """SELECT s.doc_id, title AS file_name, status, coalesce(processing_stage, status) AS stage, coalesce(cur, 0) AS current, coalesce(tot, 0) AS total,
              CASE WHEN coalesce(tot, 0) > 0 THEN round_even(CAST(coalesce(cur, 0) AS DOUBLE) / tot * 100, 1) ELSE 0.0 END AS percent FROM doc_state s
            LEFT JOIN (SELECT doc_id, count(*) AS tot FROM chunks GROUP BY doc_id) a ON a.doc_id = s.doc_id
            LEFT JOIN (SELECT doc_id, count(*) AS cur FROM chunks c JOIN vectors v ON v.chunk_id = c.chunk_id GROUP BY doc_id) b ON b.doc_id = s.doc_id""",
         ["chunks", "vectors", "doc_state"])
register("index_write", lambda t: ing.index_write(points(t), incoming(t)).select(*COLS),
         """SELECT index_name, point_id, doc_id, chunk_index FROM pts p WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.index_name = p.index_name AND i.doc_id = p.doc_id)
            UNION ALL SELECT * FROM inc""", P, POINTS + ",\n" + INCOMING)
