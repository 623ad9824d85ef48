"""Exact top-k, whitening and collocations against brute force, with nulls, ties, repeats and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import collocations, vector_topk, whitening


def _vectors(spark, rows, parts=3):
    schema = "vec_id long, embedding array<float>, label int, score string, rank string, n string, block string"
    return spark.createDataFrame([(i, v, 1, "s", "r", "n", "b") for i, v in rows], schema).repartition(parts)


@pytest.fixture(scope="module")
def vector_rows():
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((240, 20)).astype(np.float32)
    base[40:120] = base[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(50, rows[50][1]), (None, rows[60][1]), (None, None), (300, None), (350, [1.0, None] + [0.0] * 18), (400, [float("nan")] + [0.0] * 19),
             (450, [float("inf")] + [1.0] * 19), (500, [0.0] * 20), (550, []), (600, [1.0, 2.0])]
    return rows


def _top(rows, k):
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for q, x in whole:
        if q is None or q % 50:
            continue
        scores = sorted((-int(x @ y), c is None, c or 0) for c, y in whole if c != q and len(x) == len(y))
        out += [(q, r + 1, None if n else c, -s) for r, (s, n, c) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_vectors(spark, vector_rows, monkeypatch, small):
    if small:  # several blocks of both kinds, several tiles, and no pair-by-pair scoring
        for name, value in {"BLOCK_VALUES": 200, "QUERY_VALUES": 40, "BUCKET_BLOCKS": 2, "TILE": 2, "STEP": 6, "SEEDS": 2, "SPARSE": 0}.items():
            monkeypatch.setattr(vector_topk, name, value)
    vectors = _vectors(spark, vector_rows)
    found = vector_topk.top_vectors(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == _top(vector_rows, 5)


def test_top_vectors_survivors_by_bounds():
    rnd = np.random.default_rng(5)
    for size in (np.int16, np.int32, np.int64):
        wide = {np.int16: 200, np.int32: 3000, np.int64: 10**8}[size]
        q, c = (vector_topk._Block(rnd.integers(-wide, wide, (40, n)).astype(size), np.arange(n) + first, np.ones(n, bool)) for n, first in ((30, 0), (500, 10)))
        best = vector_topk._Best(30, 4)
        vector_topk._meet(q, c, np.full(30, vector_topk._NONE), best)
        scores = q.matrix.T.astype(object) @ c.matrix.astype(object)
        for i in range(30):
            assert best.score[i].tolist() == sorted((s for s, j in zip(scores[i], c.ids, strict=True) if j != i), reverse=True)[:4]


def test_top_vectors_few_and_empty(spark):
    few = _vectors(spark, [(0, [1.0, 0.0]), (50, [0.5, 0.5])], 1)
    assert sorted(map(tuple, vector_topk.top_vectors(few, few, 5).collect())) == [(0, 1, 50, 128 * 256), (50, 1, 0, 128 * 256)]
    none = few.where("vec_id < 0")
    assert vector_topk.top_vectors(none, none).collect() == [] and vector_topk.top_vectors(none, none).columns == ["query_id", "rank", "vec_id", "score"]
    assert vector_topk.top_vectors(few, none).collect() == []
    huge = _vectors(spark, [(0, [1e30, 0.0]), (50, [0.5, 0.5])], 1)
    with pytest.raises(Exception, match="64 bits"):
        vector_topk.top_vectors(huge, huge).collect()


def _whitened(rows, components, dims):
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v in rows if v and None not in v and np.isfinite(v).all() and len(v) == dims]).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - total) ** 2).sum(1), values[::-1] / values.sum(), centred @ axes[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, vector_rows, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    found = whitening.whiten(_vectors(spark, vector_rows, parts), 8).toPandas()
    n, deviation, explained, white = _whitened(vector_rows, 8, 20)
    assert (found["n"] == n).all() and len(found) == 8 * n and found["identity_error"].max() < 1e-10
    assert Counter(found[found["component"] == 1]["deviation"]) == Counter(deviation.tolist())
    assert np.allclose(found.groupby("component")["explained"].first(), explained[:8], rtol=1e-10)
    by_id = found[found["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    ids = [i for i, v in vector_rows if v and None not in v and np.isfinite(v).all() and len(v) == 20]
    want = {i: w for i, w in zip(ids, white, strict=True) if i is not None}
    signs = np.sign((by_id.to_numpy() * np.array([want[i] for i in by_id.index])).sum(0))
    assert np.allclose(by_id.to_numpy() * signs, [want[i] for i in by_id.index], atol=1e-9)


def test_whitening_degenerate(spark):
    schema = whitening.whiten(_vectors(spark, [(1, None), (2, [])])).schema
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])] * 9)).collect() == []
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(7)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 7 and all(abs(abs(r["whitened"]) - abs(r["vec_id"] - 3) / 2) < 1e-12 for r in line)
    assert line[0].asDict().keys() == {f.name for f in schema} and abs(line[0]["explained"] - 1) < 1e-12


def test_rank_one_updates():
    rnd = np.random.default_rng(1)
    for dims in (1, 2, 7, 30):
        rows = np.floor(rnd.standard_normal((80, dims)) * 8)
        rows[20:40] = rows[3]
        rows[:, -1] = rows[:, 0]
        centred = rows - rows.mean(0)
        whole = centred.T @ centred
        for cut in (1, 5, 80):
            seen, other = whitening.Spectrum(dims), whitening.Spectrum(dims)
            for start in range(0, 40, cut):
                seen.add(rows[start:min(40, start + cut)])
            other.add(rows[40:])
            seen.merge(other)
            assert seen.n == 80 and seen.sums == [int(s) for s in rows.sum(0)]
            assert np.allclose(seen.axes * seen.values @ seen.axes.T, whole, atol=1e-11 * abs(whole).max())
            assert np.allclose(seen.axes.T @ seen.axes, np.eye(dims), atol=1e-12)


def _phrases(rows, longest, least, keep, subsumed):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        count = counts.setdefault(lang, Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            count.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        found = []
        for p, a in cands.items():
            if 100 * inside[p] >= subsumed * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, r, p, a, left, right, words[lang], s) for r, (s, a, p, left, right) in enumerate(found[:keep], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rnd = random.Random(8)
    vocab = ["of", "The", "été", "日本", "x", "New", "york", "\x00", "a" * 30]
    make = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "]) for _ in range(n))
    rows = [(rnd.choice(["en", "de", None, "und", ""]), make(rnd.randrange(60))) for _ in range(60)]
    return rows + [("en", None), (None, ""), ("fr", " \t "), ("en", make(4000)), ("xx", "one two three four five"), ("en", "New York city. " * 40)] + [rows[0]] * 9


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, phrase_rows, monkeypatch, small):
    if small:  # many flushes, short rows of stripes, hot prefixes, several sorted groups
        for name, value in {"FLUSH_BYTES": 300, "PIECE": 2, "HOT_PREFIX": 8, "SORT_ROWS": 10}.items():
            monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(None, t, lang, "p", "w", 1) for lang, t in phrase_rows], "doc_id long, text string, lang string, phrase string, words string, a int").repartition(5)
    found = collocations.mine_collocations(docs, 4, 5, 40, 80).collect()
    assert sorted(map(tuple, found)) == _phrases(phrase_rows, 4, 5, 40, 80)


def test_collocations_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine_collocations(docs).collect() == []
    nulls = spark.createDataFrame([(None, None), ("", "en"), ("., ;", None)], "text string, lang string")
    assert collocations.mine_collocations(nulls).collect() == []


def test_stripes_keep_all_counts(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "lang string, text string").where("lang = 'en' and text is not null").select("lang", "text")
    merged = collocations._merged(collocations._partial_stripes(docs, 1), 1)
    total = merged.agg(F.sum("total"), F.sum(F.aggregate("count", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    assert total[0] == total[1] == _phrases([r for r in phrase_rows if r[0] == "en"], 2, 1, 1, 101)[0][6]


def test_rows_of_stripes_are_bounded_by_buckets(spark):
    docs = spark.createDataFrame([("en", " ".join(f"w{i} v{i % 7}" for i in range(3000)))], "lang string, text string").coalesce(1)
    every = spark.sparkContext.broadcast(b"\xff" * 64)
    none = spark.sparkContext.broadcast(bytes(64))
    partial = collocations._partial_stripes(docs, 2, 8, every, none)
    entries = partial.select(F.sum(F.size("next"))).first()[0]
    assert entries == 6000 - 1 and partial.count() <= 8 + entries // collocations.PIECE
    got = {(r["prefix"], n, c) for r in collocations._merged(partial, 1).collect() for n, c in zip(r["next"], r["count"], strict=True)}
    assert len(got) == entries and ("w5", "v5", 1) in got and ("v5", "w6", 1) in got


def test_stripes_of_a_bucket_meet_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MERGE_ROWS", 1)
    monkeypatch.setattr(collocations, "PIECE", 3)
    docs = spark.createDataFrame([("en", " ".join(f"w{i % 40} v{i % 7}" for i in range(300)))] * 4, "lang string, text string").repartition(4)
    every, none = (spark.sparkContext.broadcast(x * 64) for x in (b"\xff", b"\x00"))
    merged = collocations._merged(collocations._partial_stripes(docs, 2, 2, every, none), 1).collect()
    words = [x for i in range(300) for x in (f"w{i % 40}", f"v{i % 7}")]
    counts = Counter(zip(words, words[1:]))
    assert {(r["prefix"], n): c for r in merged for n, c in zip(r["next"], r["count"], strict=True)} == {k: 4 * c for k, c in counts.items()}
    assert len(merged) == len({a for a, _ in counts}) and all(r["total"] == sum(r["count"]) for r in merged)
