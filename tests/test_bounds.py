"""Python workers get texts in bounded runs, and what belongs to a segment is worked out once."""

import pyarrow as pa

from foliant.operators import chunking as ch
from foliant.options import DEFAULTS
from foliant.streaming import ingest as ing


def test_pieces_come_in_slices(monkeypatch):
    monkeypatch.setattr(ch, "SLICE_BYTES", 2000)
    rows = [["a b. " * 100, "c " * 50], [], ["é" * 3000], ["x" * 900] * 5, [""], ["z " * 40]] * 3
    batch = pa.array([["left out"], *rows], pa.list_(pa.string())).slice(1)
    found = list(ch.slide_batch(batch, DEFAULTS))
    assert [r for part in found for r in part.to_pylist()] == [ch.slide(r, DEFAULTS) for r in rows]
    size = lambda r: sum(len(x.encode()) for x in r)
    at = 0
    for part in found:
        assert len(part) == 1 or sum(map(size, rows[at:at + len(part)])) <= 2000
        at += len(part)
    assert list(ch.slide_batch(batch.slice(0, 0), DEFAULTS)) == []


def test_the_embedder_gets_bounded_runs(spark, monkeypatch):
    monkeypatch.setattr(ing, "EMBED_CHARS", 100)
    texts = [None, "", "x" * 250, *("y" * n for n in range(1, 90, 7)), " ", "z" * 100]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string").coalesce(1)
    got = {r["chunk_id"]: r["vector"] for r in ing.embed_chunks(chunks, lambda batch: [[float(sum(map(len, batch))), float(len(batch)), float(len(x))] for x in batch]).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if not (text or "").strip():
            assert got[i] == []
        else:
            assert got[i][2] == len(text) and (got[i][0] <= 100 or got[i][1] == 1)


def test_the_header_of_a_segment_is_found_once(spark):
    docs = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 900)], "doc_id int, text string")
    found = ch.chunk_text(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^\|[|\- ]*$") == 1
    contents = [r["content"] for r in found.orderBy("chunk_index").collect()]
    assert len(contents) > 2 and all(c.startswith("| a | b |\n| --- | --- |\n| 1") for c in contents)
