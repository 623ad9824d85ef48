"""Document ingestion as a Structured Streaming job.

Jobs arrive as JSON lines.  Locks, attempts and expiry are keyed state
(``claims``); each micro-batch takes the claims that the state grants, extracts,
checks, chunks, embeds and indexes their documents, and its outcomes flow back
into the state.  Every table is written into a folder of its batch, overwritten
when a batch is replayed, so a restart repeats a batch without doubling it; the
latest batch of a document is its current state.  A document that the guard or
the embedder fails on fails alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from foliant import vocab
from foliant.functions import kinds, numbers, text
from foliant.operators.chunking import chunk_router
from foliant.options import DEFAULTS, Options
from foliant.session import cut_lineage
from foliant.sources.index import change_points, compact_points, index_delete_by_document, index_name, index_upsert, load_points
from foliant.streaming.claims import EVENT, decisions, event

JOB = ("DocumentId bigint, FileId bigint, StoredFileId bigint, UserId bigint, ConversationId bigint, FileName string, "
       "DocumentType string, Attempt int, QueuedAtUtc timestamp, _bad string")
Embedder = Callable[[list[str]], list[list[float]]]
#: Characters that the embedder gets at a time, one text at least.
EMBED_CHARS = 1 << 20


# ── jobs ──────────────────────────────────────────────────────────────────────


def _parsed(raw: DataFrame) -> DataFrame:
    job = F.from_json("value", JOB, {"columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("_job", job)


def _usable() -> Column:
    return F.col("_job").isNotNull() & F.col("_job._bad").isNull() & F.col("_job.DocumentId").isNotNull()


def ingest_jobs(raw: DataFrame) -> DataFrame:
    """Job rows from JSON lines (value); malformed and null messages are left out."""
    j = "_job."
    keep = [c for c in raw.columns if c != "value"]
    return _parsed(raw).where(_usable()).select(
        *keep, F.col(j + "DocumentId").alias("doc_id"), F.col(j + "FileId").alias("file_id"), F.col(j + "StoredFileId").alias("stored_file_id"),
        F.col(j + "UserId").alias("user_id"), F.coalesce(j + "FileName", F.lit("")).alias("file_name"),
        F.coalesce(j + "DocumentType", F.lit("")).alias("document_type"), F.coalesce(j + "Attempt", F.lit(1)).alias("attempt"),
        F.col(j + "QueuedAtUtc").alias("queued_at"))


def dead_letters(raw: DataFrame) -> DataFrame:
    """Messages that ``ingest_jobs`` leaves out."""
    return _parsed(raw).where(~F.coalesce(_usable(), F.lit(False))).drop("_job")


# ── claiming ──────────────────────────────────────────────────────────────────


def idempotency_filter(jobs: DataFrame, state: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Adds outcome: unknown, ready, blocked, exhausted or open."""
    known = state.select("doc_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    outcome = (F.when(F.col("_status").isNull(), "unknown").when(F.col("_status") == "Ready", "ready")
               .when(F.col("_status") == "Blocked", "blocked").when(F.col("_attempts") >= options.max_attempts, "exhausted")
               .otherwise("open"))
    return jobs.join(known, "doc_id", "left").withColumn("outcome", outcome).drop("_status", "_attempts")


def claim_documents(jobs: DataFrame, state: DataFrame, now: Column, claimant: Column, options: Options = DEFAULTS) -> DataFrame:
    """One claim per open document whose lock is free or expired.

    A document queued many times is reduced to its earliest job with map-side
    combine before it meets the state.
    """
    order = F.struct("queued_at", *[c for c in ("job_no", "file_name") if c in jobs.columns])
    payload = [c for c in jobs.columns if c not in ("doc_id", "outcome")]
    first = (jobs.where(F.col("outcome") == "open").groupBy("doc_id")
             .agg(F.min_by(F.struct(*payload), order).alias("job")))
    free = F.col("lock_id").isNull() | (F.col("lock_expires") <= now)
    return (first.join(state.select("doc_id", "attempts", "lock_id", "lock_expires"), "doc_id").where(free)
            .select("doc_id", "job.*", F.lit("Processing").alias("status"), (F.col("attempts") + 1).alias("attempts"),
                    F.concat(claimant, F.lit("-"), F.col("doc_id").cast("string")).alias("lock_id"),
                    (now + F.make_dt_interval(mins=F.lit(options.lock_minutes))).alias("lock_expires")))


# ── stages ────────────────────────────────────────────────────────────────────


def structured_ready(document_type: Column | str, extracted: Column | str, options: Options = DEFAULTS) -> Column:
    """Spreadsheets with text can answer exact questions before vectors exist."""
    return F.lit(options.structured_ready_first) & kinds.is_table_type(document_type) & ~text.is_blank(extracted)


def ingest_transition(claimed: DataFrame, verdicts: DataFrame, chunk_counts: DataFrame, model_ready: Column | bool = True,
                      options: Options = DEFAULTS, failures: DataFrame | None = None) -> DataFrame:
    """Final state of claimed documents.

    ``claimed``: doc_id, document_type, has_file, extracted_text; ``verdicts``: doc_id,
    should_continue, error_message; ``chunk_counts``: doc_id, chunks; ``failures``: doc_id, failure, what went wrong in a stage.
    A readable document without a verdict fails.
    """
    model_ready = model_ready if isinstance(model_ready, Column) else F.lit(model_ready)
    j = (claimed.join(verdicts.select("doc_id", "should_continue", F.col("error_message").alias("_reason")), "doc_id", "left")
         .join(chunk_counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))))
    j = j.withColumn("failure", F.lit(None).cast("string")) if failures is None else j.join(failures.select("doc_id", "failure"), "doc_id", "left")
    blank, stopped = text.is_blank("extracted_text"), ~F.col("should_continue")
    failure = F.coalesce("failure", F.when(F.col("should_continue").isNull(), vocab.VERDICT_MISSING))
    error = (F.when(~F.col("has_file"), vocab.FILE_MISSING)
             .when(blank, vocab.TEXT_MISSING)
             .when(failure.isNotNull(), failure)
             .when(stopped, F.coalesce("_reason", F.lit(vocab.GUARD_DEFAULT_REASON)))
             .when(~model_ready, vocab.MODEL_MISSING))
    status = (F.when(~F.col("has_file") | blank | failure.isNotNull(), "Failed").when(stopped, "Blocked").when(~model_ready, "Failed").otherwise("Ready"))
    j = j.withColumn("error_message", error).withColumn("status", status)
    ready = F.col("status") == "Ready"
    return j.select(
        "doc_id", "status", "error_message", F.when(F.col("status") == "Blocked", F.col("error_message")).alias("block_reason"),
        F.when(F.col("has_file") & (F.col("status") != "Blocked"), F.col("extracted_text")).alias("extracted_text"),
        (F.col("has_file") & structured_ready("document_type", "extracted_text", options)).alias("structured_ready"), ready.alias("index_ready"),
        F.when(ready, F.col("chunks")).alias("progress_current"), F.when(ready, F.col("chunks")).alias("progress_total"),
        F.when(ready, F.lit(100.0)).alias("progress_percent"))


def stage_changes(outcomes: DataFrame) -> DataFrame:
    """One row per stage a document went through, in order: step, status, stage, current, total, percent, error_message.

    ``outcomes``: doc_id, has_file, readable, judged (the guard answered), passed (it let the document through), embedded, chunks,
    status, error_message; further columns are carried along.
    """
    n, none = F.col("chunks"), F.lit(0).cast("bigint")

    def row(when: Column, status: Column | str, stage: Column | str, current: Column, total: Column) -> Column:
        put = lambda x: F.lit(x) if isinstance(x, str) else x
        share = F.when(total > 0, numbers.half_even(current / total * 100, 1)).otherwise(F.lit(0.0))
        return F.when(when, F.struct(put(status).alias("status"), put(stage).alias("stage"), current.cast("bigint").alias("current"),
                                     total.cast("bigint").alias("total"), share.alias("percent")))

    passed, embedded = F.col("passed"), F.col("passed") & F.col("embedded")
    reached = F.when(embedded, "Indexing").when(passed, "Embedding").when(F.col("has_file"), "Extracting").otherwise(F.col("status"))
    done, total = F.when(embedded, n).otherwise(none), F.when(passed, n).otherwise(none)
    last = row(F.lit(True), F.col("status"), F.when(F.col("status") == "Ready", "Ready").otherwise(reached), done, total)
    steps = F.array_compact(F.array(
        row(F.col("has_file"), "Extracting", "Extracting", none, none), row(passed, "Chunking", "Chunking", none, none),
        row(passed, "Embedding", "Embedding", none, n), row(embedded, "Indexing", "Indexing", n, n), last))
    carried = [c for c in outcomes.columns if c not in ("status", "has_file", "judged", "passed", "embedded", "chunks", "error_message")]
    rows = outcomes.select(*carried, "error_message", F.col("status").alias("_final"), F.posexplode(steps).alias("step", "s"))
    ended = F.col("s.status") == F.col("_final")
    return rows.select(*carried, "step", "s.*", F.when(ended, F.col("error_message")).alias("error_message"))


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic stand-in for a remote embedding model: signed word hashing, unit length.

    A word is hashed once per batch; the batch's vectors are sums over (text, word) counts.
    """
    def embed(batch: list[str]) -> list[list[float]]:
        places: dict[str, int] = {}
        words = [re.findall(r"\w+", content.lower()) for content in batch]
        at = np.array([places.setdefault(w, len(places)) for ws in words for w in ws], dtype=np.int64)
        hashes = np.array([zlib.crc32(w.encode("utf-8")) for w in places], dtype=np.int64)
        rows = np.repeat(np.arange(len(batch)), [len(ws) for ws in words])
        signs = np.where(hashes & 0x10000, 1.0, -1.0)
        cells = rows * dimensions + hashes[at] % dimensions if len(at) else at
        out = np.bincount(cells, signs[at] if len(at) else None, len(batch) * dimensions).reshape(len(batch), dimensions)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32).tolist()
    return embed


def _vectors(embedder: Embedder, contents: list[str], isolate: bool) -> list[tuple[list[float], str | None]]:
    """(vector, what went wrong) of each text; a batch that fails is halved until the texts that fail stand alone."""
    try:
        return [(v, None) for v in embedder(contents)]
    except Exception as e:
        if not isolate:
            raise
        if len(contents) == 1:
            return [([], f"{type(e).__name__}: {e}")]
    half = len(contents) // 2
    return _vectors(embedder, contents[:half], True) + _vectors(embedder, contents[half:], True)


def embed_chunks(chunks: DataFrame, embedder: Embedder, isolate: bool = False) -> DataFrame:
    """One vector per chunk, empty for blank content; the embedder gets runs of texts with EMBED_CHARS characters or one text.

    With ``isolate`` a text that the embedder fails on gets an empty vector and the reason in ``failure``; the rest go on.
    """
    made = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("failure", T.StringType())])

    @F.pandas_udf(made)
    def vectors_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.fillna("")
            ends, start = texts.str.len().cumsum().to_numpy(), 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EMBED_CHARS, side="right")))
                part = texts.iloc[start:end]
                filled = (part.str.strip() != "").to_numpy()
                found = iter(_vectors(embedder, part[filled].tolist(), isolate) if filled.any() else [])
                rows = [next(found) if f else ([], None) for f in filled]
                yield pd.DataFrame({"vector": [v for v, _ in rows], "failure": [f for _, f in rows]})
                start = end

    out = chunks.withColumn("_made", vectors_of("content")).withColumn("vector", F.col("_made.vector"))
    return (out.withColumn("failure", F.col("_made.failure")) if isolate else out).drop("_made")


def _reason(e: Exception) -> str:
    """The line that says what a function on a worker raised, or the first line."""
    said = re.findall(r"(?m)^(?:\w+\.)*\w*(?:Error|Exception): .*$", str(e))
    return (said[-1] if said else str(e).splitlines()[0] if str(e) else type(e).__name__).strip()


def guard_verdicts(judged: DataFrame, guard: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, should_continue, error_message, failure) of the guard's answers.

    Where the guard raises on a set of documents, halves of the set are tried, so that a document that
    it can't bear fails alone, after a number of tries in the logarithm of the batch.
    """
    schema = f"doc_id {judged.schema['doc_id'].dataType.simpleString()}, should_continue boolean, error_message string, failure string"
    found, waiting = [], [(1, 0)]
    while waiting:
        parts, rest = waiting.pop()
        some = judged if parts == 1 else judged.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == rest)
        try:
            found.append(cut_lineage(guard(some).select("doc_id", "should_continue", "error_message", F.lit(None).cast("string").alias("failure"))))
        except Exception as e:
            left = some.select("doc_id").distinct().limit(2).collect()
            if len(left) == 1 or parts >= 1 << 40:
                found.append(some.select("doc_id").distinct().select("doc_id", F.lit(None).cast("boolean").alias("should_continue"),
                                                                     F.lit(None).cast("string").alias("error_message"), F.lit(_reason(e)).alias("failure")))
            elif left:
                waiting += [(2 * parts, rest), (2 * parts, rest + parts)]
    out = judged.sparkSession.createDataFrame([], schema) if not found else found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def ingest_progress(chunks: DataFrame, vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Progress messages: done and total chunks, percent with one decimal, stage.

    ``chunks``: doc_id, chunk_index; ``vectors``: doc_id, chunk_index, vector; ``state``: doc_id, title, status, processing_stage.
    """
    total = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    done = vectors.where(F.size("vector") > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("current"))
    j = state.join(total, "doc_id", "left").join(done, "doc_id", "left")
    current, whole = F.coalesce("current", F.lit(0)), F.coalesce("total", F.lit(0))
    share = F.when(whole > 0, numbers.half_even(current / whole * 100, 1)).otherwise(F.lit(0.0))
    return j.select("doc_id", F.col("title").alias("file_name"), "status", F.coalesce("processing_stage", "status").alias("stage"),
                    current.alias("current"), whole.alias("total"), share.alias("percent"))


def index_points(chunks: DataFrame, vectors: DataFrame, provider: str, model: str, options: Options = DEFAULTS,
                 documents: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """Index points of embedded chunks with their payload.

    ``documents``: doc_id, title, user_id, file_id, file_name; ``access``: doc_id, collection_ids, allowed_group_ids.
    """
    made = vectors.where(F.size("vector") > 0).select("doc_id", "chunk_index", "vector")
    points = chunks.join(made, ["doc_id", "chunk_index"]).select(
        index_name(F.lit(provider), F.lit(model), options.index_prefix).alias("index_name"), F.col("chunk_id").alias("point_id"), "doc_id",
        "chunk_index", *[c for c in ("page_number", "heading") if c in chunks.columns], "vector",
        text.left("content", options.preview_chars).alias("content_preview"), F.lit(provider).alias("provider"), F.lit(model).alias("model"))
    if documents is not None:
        points = points.join(documents.select("doc_id", F.col("title").alias("document_title"), "user_id", "file_id", "file_name"), "doc_id", "left")
    nobody = F.array().cast("array<string>")
    if access is None:
        return points.withColumns({"collection_ids": nobody, "allowed_group_ids": nobody})
    lists = {c: F.coalesce(c, nobody) for c in ("collection_ids", "allowed_group_ids")}
    return points.join(access.select("doc_id", *lists), "doc_id", "left").withColumns(lists)


def index_write(points: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index after re-indexing documents: their old points go first, then the new ones come in."""
    return index_upsert(index_delete_by_document(points, incoming.select("index_name", "doc_id").distinct()), incoming)


# ── the stream ────────────────────────────────────────────────────────────────


@dataclass
class IngestStore:
    """Append-only tables below one shared folder, one sub-folder per batch; the index below ``index``."""

    spark: SparkSession
    path: str

    @property
    def index(self) -> str:
        return f"{self.path}/index"

    def write(self, table: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def read(self, table: str, before: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{table}")
        return df if before is None else df.where(F.col("batch_id") < before)

    def latest(self, table: str, before: int | None = None) -> DataFrame:
        """Rows of each document's newest batch; of points, those that the index holds."""
        if table == "points":
            return load_points(self.spark, self.index)
        rows = self.read(table, before)
        newest = rows.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, ["doc_id", "batch_id"], "left_semi")

    def changes(self) -> DataFrame:
        """The stage changes as a stream."""
        return self.spark.readStream.schema(f"{CHANGES}, batch_id bigint").parquet(f"{self.path}/stages")


STATE = ["doc_id", "title", "document_type", "file_name", "status", "attempts", "lock_id", "lock_expires", "error_message", "chunks"]
OUTCOME = "doc_id bigint, status string, lock_id string"
CHANGES = ("doc_id bigint, title string, user_id bigint, file_id bigint, file_name string, attempts int, step int, status string, stage string, "
           "current bigint, total bigint, percent double, error_message string")


def register_documents(store: IngestStore, documents: DataFrame) -> None:
    """Initial state, batch -1: doc_id, title, document_type, file_name, status; file_id and user_id where known.

    Registering a known document again lets it be processed anew, unless a claim holds it.
    """
    store.write("documents", documents.select(
        "doc_id", "title", "document_type", "file_name", "status", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("lock_id"),
        F.lit(None).cast("timestamp").alias("lock_expires"), F.lit(None).cast("string").alias("error_message"), F.lit(0).cast("bigint").alias("chunks")), -1)
    known = {c: c for c in ("doc_id", "title", "document_type", "file_name", "file_id", "user_id", "status") if c in documents.columns}
    event(documents, "registered", at=F.current_timestamp(), **known).write.mode("append").parquet(f"{store.path}/registered")


def _work(claimed: DataFrame, batch_id: int, store: IngestStore, texts: DataFrame, guard: Callable[[DataFrame], DataFrame], embedder: Embedder,
          provider: str, model: str, options: Options, access: DataFrame | None) -> DataFrame:
    """Claimed documents (doc_id, title, document_type, file_name, file_id, user_id, attempts, lock_id) to their outcomes.

    Writes chunks, vectors, index, stages and progress, and returns each document's new state with its lock_id.
    """
    asked_texts = texts.join(claimed.select("doc_id"), "doc_id", "left_semi")  # the claims are few; all other texts stay where they are
    work = (claimed.select("doc_id", "document_type").join(asked_texts, "doc_id", "left")
            .withColumn("has_file", F.col("text").isNotNull()).withColumn("extracted_text", F.col("text")))
    judged = work.where(~text.is_blank("text")).select("doc_id", "text")
    verdicts = guard_verdicts(judged, guard)
    passed = work.join(verdicts.where("should_continue").select("doc_id"), "doc_id", "left_semi")
    chunks = cut_lineage(chunk_router(passed.select("doc_id", "text"), options).withColumn(
        "chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))))
    embedded = cut_lineage(embed_chunks(chunks.select("doc_id", "chunk_index", "content"), embedder, isolate=True).drop("content"))
    broken = embedded.where("failure is not null").groupBy("doc_id").agg(F.min_by("failure", "chunk_index").alias("failure"))
    failures = cut_lineage(verdicts.where("failure is not null").select("doc_id", "failure").unionByName(broken))
    kept = embedded.join(broken.select("doc_id"), "doc_id", "left_anti")
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    final = ingest_transition(work, verdicts, counts, options=options, failures=failures).select("doc_id", "status", "error_message")
    facts = work.select("doc_id", "has_file").join(verdicts.select("doc_id", "should_continue"), "doc_id", "left").join(
        broken.select("doc_id", F.lit(False).alias("embedded")), "doc_id", "left").join(counts, "doc_id", "left")
    facts = facts.select("doc_id", "has_file", F.coalesce("should_continue", F.lit(False)).alias("passed"), F.coalesce("embedded", F.lit(True)).alias("embedded"),
                         F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))
    outcomes = cut_lineage(claimed.select("doc_id", "title", "document_type", "file_name", "file_id", "user_id", "attempts", "lock_id")
                           .join(final, "doc_id").join(facts, "doc_id"))
    store.write("chunks", chunks, batch_id)
    points = index_points(chunks, kept, provider, model, options, claimed, access)
    store.write("vectors", points.select("doc_id", F.col("point_id").alias("chunk_id"), "provider", "model", "vector"), batch_id)
    name = index_name(F.lit(provider), F.lit(model), options.index_prefix).alias("index_name")
    change_points(store.spark, store.index, points, outcomes.where("status = 'Ready'").select(name, "doc_id"), batch_id)
    compact_points(store.spark, store.index)
    store.write("stages", stage_changes(outcomes.drop("document_type", "lock_id")).select(*[c.split()[0] for c in CHANGES.split(", ")]), batch_id)
    ready = outcomes.withColumn("chunks", F.when(F.col("status") == "Ready", F.col("chunks")).otherwise(0))
    return ready.select("doc_id", "title", "document_type", "file_name", "status", "attempts", "lock_id", "error_message", "chunks")


def _released(rows: DataFrame) -> DataFrame:
    return rows.drop("lock_id", "lock_expires").select("*", F.lit(None).cast("string").alias("lock_id"), F.lit(None).cast("timestamp").alias("lock_expires")).select(*STATE)


def _finish(store: IngestStore, after: DataFrame, batch_id: int) -> None:
    chunks, vectors = store.read("chunks").where(F.col("batch_id") == batch_id), store.read("vectors").where(F.col("batch_id") == batch_id)
    store.write("progress", ingest_progress(chunks, vectors, after.withColumn("processing_stage", F.lit(None).cast("string"))), batch_id)
    store.write("documents", after, batch_id)  # last: a batch counts once its state is there


def process_batch(raw: DataFrame, batch_id: int, store: IngestStore, texts: DataFrame, guard: Callable[[DataFrame], DataFrame],
                  embedder: Embedder, provider: str, model: str, options: Options = DEFAULTS, access: DataFrame | None = None) -> None:
    """One batch from messages to index without a running stream, claimed by the stored state of its documents.

    ``access``: doc_id, collection_ids, allowed_group_ids (arrays of strings, a row per document); both are empty
    without it.  ``texts``: doc_id, text; ``guard``: documents (doc_id, text) to verdicts (doc_id, should_continue, error_message).
    The clock is the newest queue time of the batch, so a replay decides alike.
    """
    raw = cut_lineage(raw)
    store.write("dead_letters", dead_letters(raw), batch_id)
    jobs = cut_lineage(ingest_jobs(raw))
    asked = jobs.select("doc_id").distinct()
    state = cut_lineage(store.latest("documents", batch_id).join(asked, "doc_id", "left_semi"))
    sorted_jobs = idempotency_filter(jobs, state, options)
    now = jobs.agg(F.max("queued_at")).scalar()
    claimed = claim_documents(sorted_jobs, state, now, F.lit(f"batch{batch_id}"), options).select("doc_id", "attempts", "lock_id", "file_id", "user_id")
    claimed = cut_lineage(claimed.join(state.select("doc_id", "title", "document_type", "file_name"), "doc_id"))
    done = _work(claimed, batch_id, store, texts, guard, embedder, provider, model, options, access)
    exhausted = sorted_jobs.where(F.col("outcome") == "exhausted").select("doc_id").distinct()
    failed = state.join(exhausted, "doc_id", "left_semi").withColumn("status", F.lit("Failed")).withColumn("error_message", F.lit(vocab.ATTEMPTS_EXCEEDED))
    _finish(store, cut_lineage(_released(done).unionByName(_released(failed))), batch_id)


def _decided(decided: DataFrame, batch_id: int, store: IngestStore, texts: DataFrame, guard: Callable[[DataFrame], DataFrame],
             embedder: Embedder, provider: str, model: str, options: Options, access: DataFrame | None) -> None:
    """One micro-batch of decisions of the keyed state."""
    decided = cut_lineage(decided)
    store.write("dead_letters", decided.where("kind = 'lost'").select("value"), batch_id)
    claimed = decided.where("kind = 'claimed'")
    done = cut_lineage(_work(claimed, batch_id, store, texts, guard, embedder, provider, model, options, access))
    failed = decided.where("kind = 'exhausted'").withColumn("chunks", F.lit(0).cast("bigint"))
    _finish(store, cut_lineage(_released(done).unionByName(_released(failed))), batch_id)
    store.write("outcomes", done.select("doc_id", "status", "lock_id"), batch_id)  # what the state hears with the next batch


def start_ingestion(spark: SparkSession, source: str, store: IngestStore, texts: DataFrame, guard: Callable[[DataFrame], DataFrame],
                    embedder: Embedder, provider: str, model: str, options: Options = DEFAULTS, max_files: int = 1000,
                    access: DataFrame | None = None) -> StreamingQuery:
    """Start the job over a folder of JSON-line files; it ends when the folder is drained.

    Registrations, jobs and the outcomes of earlier batches meet in the keyed state of their document.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # with processing-time timers a query that may run batches without data never drains; expired locks are noticed with the next events
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.createDataFrame([], OUTCOME).write.mode("overwrite").parquet(f"{store.path}/outcomes/batch_id=-1")
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(source)
    parsed = _parsed(raw)
    jobs = event(ingest_jobs(raw), "job", doc_id="doc_id", at="queued_at", file_name=F.nullif("file_name", F.lit("")), file_id="file_id", user_id="user_id")
    lost = event(parsed.where(~F.coalesce(_usable(), F.lit(False))), "lost", value="value")
    registered = event(spark.readStream.schema(EVENT).parquet(f"{store.path}/registered"), "registered", **{c: c for c in (
        "doc_id", "at", "status", "title", "document_type", "file_name", "file_id", "user_id")})
    heard = spark.readStream.schema(f"{OUTCOME}, batch_id bigint").parquet(f"{store.path}/outcomes")
    outcomes = event(heard, "outcome", doc_id="doc_id", status="status", lock_id="lock_id")
    decided = decisions(registered.union(outcomes).union(jobs).union(lost), options)
    return (decided.writeStream.foreachBatch(lambda df, n: _decided(df, n, store, texts, guard, embedder, provider, model, options, access))
            .option("checkpointLocation", f"{store.path}/_stream").outputMode("update").trigger(availableNow=True).start())
