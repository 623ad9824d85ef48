"""Files, stored index and the ingestion stream."""

import json

from pyspark.sql import functions as F

from foliant.operators import retrieval
from foliant.sources import files as fl, index as ix
from foliant.streaming import ingest as ing


def test_read_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhej \xff")
    (tmp_path / "b.PY").write_text("print(1)\n")
    (tmp_path / "c.png").write_bytes(b"\x00")
    got = {x.file_name: (x.document_type, x.text) for x in fl.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Txt", "hej �"), "b.PY": ("Code", "print(1)\n")}


def test_replace_documents_rewrites_only_their_points(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "index_name string, point_id string, doc_id bigint, vector array<float>"
    ix.save_points(spark.createDataFrame([("i", f"{d}-{k}", d, [1.0]) for d in range(20) for k in range(3)], schema), path)
    ix.replace_documents(spark, path, spark.createDataFrame([("i", "4-new", 4, [2.0]), ("i", "99-0", 99, [3.0])], schema))
    got = sorted(x.point_id for x in ix.load_points(spark, path).collect())
    assert got == sorted([f"{d}-{k}" for d in range(20) for k in range(3) if d != 4] + ["4-new", "99-0"])


def test_stream_replays_to_the_same_state(spark, tmp_path):
    source = tmp_path / "jobs"
    source.mkdir()
    jobs = [{"DocumentId": d, "UserId": 1, "FileName": f"f{d}", "DocumentType": "Txt", "QueuedAtUtc": f"2024-01-01T00:00:0{d % 10}Z"} for d in (1, 2, 3, 4, 1, 77)]
    (source / "one.json").write_text("\n".join([json.dumps(j) for j in jobs] + ['{"DocumentId": ', "null"]) + "\n")
    body = "Ett dokument om nät. " * 30
    texts = spark.createDataFrame([(1, body), (2, " "), (3, "hemligt " + body)], "doc_id bigint, text string")
    store = ing.IngestStore(spark, str(tmp_path / "store"))
    ing.register_documents(store, spark.createDataFrame([(d, f"Dok {d}", "Txt", f"f{d}", "Queued") for d in (1, 2, 3, 4)],
                                                        "doc_id bigint, title string, document_type string, file_name string, status string"))

    def guard(docs):
        stop = F.startswith("text", F.lit("hemligt"))
        return docs.select("doc_id", (~stop).alias("should_continue"), F.when(stop, "pii").alias("error_message"))

    def run():
        q = ing.start_ingestion(spark, str(source), store, texts, guard, ing.hashing_embedder(8), "acme", "small")
        q.awaitTermination()
        assert q.exception() is None
        return {x.doc_id: (x.status, x.attempts, x.error_message, x.chunks, x.lock_id) for x in store.latest("documents").collect()}

    state = run()
    assert state == {1: ("Ready", 1, None, 1, None), 2: ("Failed", 1, "Document contains no readable text.", 0, None),
                     3: ("Blocked", 1, "pii", 0, None), 4: ("Failed", 1, "Physical file not found on disk.", 0, None)}
    assert [(x.doc_id, len(x.vector)) for x in store.latest("points").collect()] == [(1, 8)]
    assert store.read("dead_letters").count() == 2
    # the same batch again, as after a crash before the stream recorded it
    ing.process_batch(spark.read.text(str(source)), 0, store, texts, guard, ing.hashing_embedder(8), "acme", "small")
    assert store.read("documents").where("batch_id = 0").count() == 4 and store.latest("points").count() == 1
    # queued again: what is Ready or Blocked stays, what failed is tried once more
    (source / "two.json").write_text("\n".join(json.dumps({**j, "QueuedAtUtc": "2024-01-02T00:00:00Z"}) for j in jobs) + "\n")
    again = run()
    assert again[1] == state[1] and again[3] == state[3] and again[2][1] == 2 and again[4][1] == 2


def test_streamed_documents_are_found_by_vectors(spark, tmp_path):
    job = {"DocumentId": 1, "UserId": 1, "FileName": "f1", "DocumentType": "Txt", "QueuedAtUtc": "2024-01-01T00:00:00Z"}
    (tmp_path / "one.json").write_text("\n".join(json.dumps({**job, "DocumentId": d}) for d in (1, 2)) + "\n")
    texts = spark.createDataFrame([(1, "Ett dokument om vatten. " * 30), (2, "Ett annat om el. " * 30)], "doc_id bigint, text string")
    access = spark.createDataFrame([(1, ["c1", "c2"], ["g1"])], "doc_id bigint, collection_ids array<string>, allowed_group_ids array<string>")
    store = ing.IngestStore(spark, str(tmp_path / "store"))
    ing.register_documents(store, spark.createDataFrame([(d, "Dok", "Txt", "f", "Queued") for d in (1, 2)],
                                                        "doc_id bigint, title string, document_type string, file_name string, status string"))
    passed = lambda docs: docs.select("doc_id", F.lit(True).alias("should_continue"), F.lit(None).cast("string").alias("error_message"))
    ing.process_batch(spark.read.text(str(tmp_path / "one.json")), 0, store, texts, passed, ing.hashing_embedder(8), "acme", "small", access=access)
    points = store.latest("points")
    asked = points.where("doc_id = 1").limit(1).select(F.lit(7).alias("query_id"), "provider", "model", F.col("vector").alias("query_vector"))
    scope = spark.createDataFrame([(7, 1), (7, 2)], "query_id int, doc_id bigint")
    assert [x.doc_id for x in retrieval.vector_topk(points, scope, asked, 1).collect()] == [1]
    member = spark.createDataFrame([(7, "c2")], "query_id int, collection_id string")
    assert {x.doc_id for x in retrieval.vector_topk_collections(points, member, asked, 5).collect()} == {1}
    chunks = store.latest("chunks").select("chunk_id", "doc_id", "chunk_index", F.lit(None).cast("int").alias("page_number"))
    found = retrieval.exact_scan(scope, store.latest("documents"), chunks, store.latest("vectors").drop("doc_id", "batch_id"), asked)
    assert {x.doc_id for x in found.collect()} == {1, 2}


def _files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_index_changes_write_new_files_only(spark, tmp_path):
    path = tmp_path / "points"
    schema = "index_name string, point_id string, doc_id bigint, vector array<float>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    live = {}

    def apply(version, rows, ended=None):
        before = _files(path) if path.exists() else {}
        ix.change_points(spark, str(path), make(rows), None if ended is None else make([("i", "", d, []) for d in ended]), version)
        assert all(_files(path).get(f) == t for f, t in before.items() if f"version={version}/" not in f)
        for d in {r[2] for r in rows} | set(ended or []):
            live.pop(d, None)
        for r in rows:
            live.setdefault(r[2], []).append(r[1])

    apply(0, [("i", f"{d}-{k}", d, [1.0]) for d in range(6) for k in range(3)])
    apply(1, [("i", "4-new", 4, [2.0])])
    apply(2, [], [0, 5, 77])
    apply(2, [], [0, 5, 77])  # a replay of the same change
    got = lambda: sorted(x.point_id for x in ix.load_points(spark, str(path)).collect())
    want = lambda: sorted(p for ps in live.values() for p in ps)
    assert got() == want()
    assert not ix.compact_points(spark, str(path), 4) and ix.compact_points(spark, str(path), 3) and got() == want()
    apply(3, [("i", "5-again", 5, [3.0]), ("i", "1-new", 1, [4.0])])
    assert got() == want() and "5-again" in got()
    ix.save_points(make([("i", "only", 9, [1.0])]), str(path))
    assert got() == ["only"]


def test_poison_documents_fail_alone_and_for_good(spark, tmp_path):
    source = tmp_path / "jobs"
    source.mkdir()
    body = "Ett dokument om nät. " * 30
    texts = spark.createDataFrame([(1, body), (2, "giftig " + body), (3, body + " sprängs"), (4, body), (5, "  ")], "doc_id bigint, text string")
    store = ing.IngestStore(spark, str(tmp_path / "store"))
    ing.register_documents(store, spark.createDataFrame([(d, f"Dok {d}", "Txt", f"f{d}", "Queued", d * 10, 7) for d in range(1, 7)],
                                                        "doc_id bigint, title string, document_type string, file_name string, status string, file_id bigint, user_id bigint"))
    plain = ing.hashing_embedder(8)

    def embedder(batch):
        if any("sprängs" in b for b in batch):
            raise ValueError("bad text")
        return plain(batch)

    def guard(docs):
        fine = F.when(F.startswith("text", F.lit("giftig")), F.raise_error(F.lit("GuardError: toxin"))).otherwise(F.lit(True))
        return docs.select("doc_id", fine.cast("boolean").alias("should_continue"), F.lit(None).cast("string").alias("error_message"))

    def run(n, ids):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"DocumentId": d, "FileName": f"in{d}", "QueuedAtUtc": f"2024-01-0{n}T00:00:00Z"}) for d in ids) + "\n")
        q = ing.start_ingestion(spark, str(source), store, texts, guard, embedder, "acme", "small")
        q.awaitTermination()
        assert q.exception() is None
        return {x.doc_id: (x.status, x.attempts, x.error_message, x.lock_id) for x in store.latest("documents").collect()}

    state = run(1, [1, 2, 3, 4, 5, 6, 1, 99])
    assert state[1] == state[4] == ("Ready", 1, None, None)
    assert state[2][:2] == ("Failed", 1) and "toxin" in state[2][2]
    assert state[3] == ("Failed", 1, "ValueError: bad text", None) and state[6] == ("Failed", 1, "Physical file not found on disk.", None)
    stages = {}
    for x in store.read("stages").orderBy("step").collect():
        stages.setdefault(x.doc_id, []).append((x.status, x.stage, x.current, x.total, x.percent))
    assert stages[1] == [("Extracting", "Extracting", 0, 0, 0.0), ("Chunking", "Chunking", 0, 0, 0.0), ("Embedding", "Embedding", 0, 1, 0.0),
                         ("Indexing", "Indexing", 1, 1, 100.0), ("Ready", "Ready", 1, 1, 100.0)]
    assert [s[:2] for s in stages[2]] == [("Extracting", "Extracting"), ("Failed", "Extracting")]
    assert [s[:2] for s in stages[3]][-2:] == [("Embedding", "Embedding"), ("Failed", "Embedding")] and [s[:2] for s in stages[6]] == [("Failed", "Failed")]
    before = _files(tmp_path / "store" / "index")
    for n in (2, 3):
        state = run(n, [2, 3])
        assert state[2][:2] == state[3][:2] == ("Failed", n)
    state = run(4, [1, 2, 3])
    assert state[2][:3] == state[3][:3] == ("Failed", 3, "Maximum processing attempts exceeded.") and state[1] == ("Ready", 1, None, None)
    after = _files(tmp_path / "store" / "index")
    assert all(after[f] == t for f, t in before.items())  # no batch rewrote an older file
    point = store.latest("points").where("doc_id = 1").first()
    assert (point.document_title, point.file_name, point.user_id, point.file_id, point.provider, point.chunk_index) == ("Dok 1", "in1", 7, 10, "acme", 0)
    followed = store.changes().writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    followed.awaitTermination()
    assert spark.table("followed").where("doc_id = 3 and status = 'Failed'").count() == 3


def test_expired_locks_are_free_again(spark, tmp_path):
    from foliant.options import Options
    from foliant.streaming import claims

    folder = tmp_path / "events"
    schema = claims.EVENT
    seen = []

    def run(n, rows):
        base = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema)
        base.coalesce(1).write.mode("append").parquet(str(folder))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        out = claims.decisions(spark.readStream.schema(schema).parquet(str(folder)), Options(lock_minutes=lock))
        q = out.writeStream.foreachBatch(lambda df, b: seen.append((n, sorted((r.kind, r.doc_id, r.attempts) for r in df.collect())))).option(
            "checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    lock = 30
    run(1, [{"kind": "registered", "doc_id": 1, "status": "Queued"}, {"kind": "job", "doc_id": 1}, {"kind": "lost", "value": "{"}])
    run(2, [{"kind": "job", "doc_id": 1}, {"kind": "registered", "doc_id": 2, "status": "Queued"}])
    lock = 0
    run(3, [{"kind": "job", "doc_id": 2}])
    run(4, [{"kind": "job", "doc_id": 2}])
    assert seen[0] == (1, [("claimed", 1, 1), ("lost", None, None)]) and seen[1] == (2, [("locked", 1, 1)])
    assert seen[2] == (3, [("claimed", 2, 1), ("expired", 2, 1)])  # a lock of no length ends by its timer at once
    assert seen[3] == (4, [("claimed", 2, 2), ("expired", 2, 2)])
