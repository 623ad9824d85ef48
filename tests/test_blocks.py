"""Blocked cosines against brute force."""

import numpy as np
import pytest

from foliant.plans import blocks


@pytest.mark.parametrize("limit", [None, 4])
@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_blocked_cosines(spark, monkeypatch, limit, ids):
    for name, value in {"BLOCK_POINTS": 8, "BLOCK_QUESTIONS": 3, "PRUNE_PAIRS": 20, "PAIRS": 16}.items():
        monkeypatch.setattr(blocks, name, value)
    rnd = np.random.default_rng(2)
    make = (lambda n: n) if ids == "bigint" else (lambda n: f"id-{n:04d}")
    vector = lambda: [float(x) for x in rnd.standard_normal(6).astype(np.float32)]
    same = vector()
    # key 0 is hot; some vectors repeat, one has no length
    points = [("a" if i % 3 else "b", make(0 if i % 2 else i % 5), make(i), same if i % 4 == 0 else [0.0] * 6 if i == 7 else vector(), f"x{i}") for i in range(90)]
    questions = [(make(100 + q), s, vector() if q else same) for q in range(8) for s in (("a", "b") if q % 2 else ("a",))]
    scope = [(make(100 + q), make(k)) for q in range(8) for k in range(5) if (q + k) % 3] + [(make(100), make(99)), (make(101), make(0)), (make(101), make(0))]
    found = blocks.blocked_cosines(spark.createDataFrame(points, f"space string, key {ids}, point_id {ids}, vector array<float>, label string").repartition(3),
                                   spark.createDataFrame(questions, f"query_id {ids}, space string, query_vector array<float>"),
                                   spark.createDataFrame(scope, f"query_id {ids}, key {ids}"), limit, -1.0 if limit is None else 0.0, ["label"]).collect()
    want = {}
    for q, s, v in questions:
        for ps, key, point, w, label in points:
            if ps == s and (q, key) in scope:
                size = np.linalg.norm(v) * np.linalg.norm(w)
                want.setdefault(q, []).append((-(np.dot(v, w) / size if size else 0.0), point, label))
    for rows in want.values():
        rows.sort(key=lambda x: (round(x[0], 9), x[1]))
    if limit:
        want = {q: [r for r in rows if r[0] <= 0][:limit] for q, rows in want.items()}
    assert len(found) == sum(map(len, want.values()))
    for q, rows in want.items():
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: (r["rank"] if limit else 0, -round(r["score"], 9), r["point_id"]))
        assert [(r["point_id"], r["label"]) for r in mine] == [r[1:] for r in rows]
        assert np.allclose([r["score"] for r in mine], [-r[0] for r in rows], atol=1e-6)


def test_blocked_cosines_without_rows(spark):
    points = spark.createDataFrame([], "space string, key bigint, point_id bigint, vector array<float>")
    questions = spark.createDataFrame([(1, "a", [1.0])], "query_id bigint, space string, query_vector array<float>")
    scope = spark.createDataFrame([(1, 2)], "query_id bigint, key bigint")
    assert blocks.blocked_cosines(points, questions, scope, 3).collect() == []
    assert blocks.blocked_cosines(points, questions.limit(0), scope).collect() == []


def test_large_blocks_give_the_rows_of_small_ones(spark, monkeypatch):
    """Batches, tiles and blocks by numbers: pairs that reach a cosine are all pairs that do."""
    rnd = np.random.default_rng(4)
    vector = lambda i: [float("inf")] * 4 if i == 5 else [0.0] * 4 if i == 6 else [float(x) for x in rnd.standard_normal(4)]
    points = spark.createDataFrame([("a", i % 3, i, vector(i)) for i in range(60)], "space string, key bigint, point_id bigint, vector array<float>")
    asking = spark.createDataFrame([(q, "a", vector(q)) for q in range(12)], "query_id bigint, space string, query_vector array<float>")
    scope = spark.createDataFrame([(q, k) for q in range(12) for k in range(3) if (q + k) % 2], "query_id bigint, key bigint")
    read = lambda df: sorted((r.query_id, r.point_id, str(r.score)) for r in df.collect())
    every = read(blocks.blocked_cosines(points, asking, scope))
    best = read(blocks.blocked_cosines(points, asking, scope, 5, float("-inf")))
    for name, value in {"BLOCK_NUMBERS": 40, "TILE": 16, "BATCH": 7, "BLOCK_LINKS": 30, "BLOCK_BEST": 20, "PRUNE_PAIRS": 9}.items():
        monkeypatch.setattr(blocks, name, value, raising=False)
    assert read(blocks.blocked_cosines(points, asking, scope)) == every
    assert read(blocks.blocked_cosines(points, asking, scope, 5, float("-inf"))) == best
    reached = read(blocks.blocked_cosines(points, asking, scope, reach=0.3))
    assert reached == [x for x in every if x[2] == "nan" or float(x[2]) >= 0.3] and 0 < len(reached) < len(every)
