"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import filter_texts, id_field, map_texts, stage, texts_of

#: Labelled documents the model is fitted on at most, picked by a hash of the id.
SAMPLE_ROWS = 8000
#: Features of the model at most.
FEATURES = 4096
#: Words a worker keeps the features of; beyond this the table starts anew.
TABLE_ENTRIES = 500_000
#: Words of a window that is judged by itself, and words from one window to the next.
WINDOW, STEP = 100, 50
_WORD = re.compile(r"[^\W\d_]+")


def names_of(word: str) -> tuple[str, ...]:
    """Features of a word: itself, and the beginning that its forms share."""
    return (word, word[:4] + "*") if len(word) > 4 else (word,)


@dataclass(frozen=True)
class Model:
    """Weights that all thresholds share, and the ordered thresholds between severity grades."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Chance, for each text, that its severity lies above each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


class _Table(dict):
    """Word -> places of its features in the model."""

    def __init__(self, features: dict[str, int]) -> None:
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self[word] = tuple(self.features[f] for f in names_of(word) if f in self.features)
        return found


def window_counts(words: list[str], table: _Table) -> tuple[Counter[int], list[Counter[int]], bool]:
    """How often each feature comes in the whole text, and in each window that has any; and whether a window has none."""
    if len(table) > TABLE_ENTRIES:
        table.clear()
    n = len(words)
    hits = [(i, p) for i, w in enumerate(words) for p in table[w]]
    whole = Counter(p for _, p in hits)
    if n <= WINDOW:
        return whole, [], False
    regular = (n - WINDOW) // STEP  # windows 0 to this one start at multiples of STEP; the last one ends with the text
    inside: dict[int, Counter[int]] = {}
    for i, p in hits:
        for k in range(max(0, (i - WINDOW) // STEP + 1), min(i // STEP, regular) + 1):
            inside.setdefault(k, Counter())[p] += 1
        if i >= n - WINDOW:
            inside.setdefault(regular + 1, Counter())[p] += 1
    return whole, list(inside.values()), len(inside) < regular + 2


def _values(counts: Counter[int], size: int) -> list[float]:
    """The logarithm of how often each feature comes in a hundred words."""
    return [math.log1p(400 * c / size) for c in counts.values()]


def highest_score(words: list[str], table: _Table, weights: np.ndarray) -> float:
    """The highest score of the whole text and of its windows.

    Severity rises with the score, so this is the score of the highest expected severity.
    """
    whole, windows, bare = window_counts(words, table)
    score = lambda counts, size: sum(weights[p] * v for p, v in zip(counts, _values(counts, size), strict=True))
    return float(max([score(whole, len(words)), *(score(c, WINDOW) for c in windows), *([0.0] if bare else [])]))


def fit_ordinal(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                penalty: float = 0.002, steps: int = 400, documents: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by full-batch Adam; entries (row, place, value) are sparse.

    P(grade > k) = 1 / (1 + exp(threshold_k - score)), so the loss is that of one logistic regression
    for each threshold over the same weights.  Later thresholds are the first plus positive steps.
    Losses are divided by ``documents``, of which rows may be parts.
    """
    levels, n, size = int(grades.max()), len(grades), documents or len(grades)
    target = (grades[:, None] > np.arange(levels)[None, :]).astype(float)
    x = np.zeros(n_features + levels)
    x[n_features] = 1.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        gaps = np.exp(x[n_features + 1:])
        thresholds = x[n_features] + np.r_[0, np.cumsum(gaps)]
        scores = np.bincount(rows, values * x[places], n)
        error = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -500, 500))) - target
        slope = np.zeros_like(x)
        slope[:n_features] = np.bincount(places, values * error.sum(1)[rows], n_features) / size + penalty * x[:n_features]
        down = -error.sum(0) / size
        slope[n_features] = down.sum()
        slope[n_features + 1:] = gaps * down[::-1].cumsum()[::-1][1:]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        x -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return x[:n_features], x[n_features] + np.r_[0, np.cumsum(np.exp(x[n_features + 1:]))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, grades: int = 3) -> Model:
    """Fit on labelled documents (label ``toxic`` 0 or 1).

    Features are the words and word beginnings whose document counts differ most between the labels
    (log-likelihood ratio over the labelled sample), however rare; the penalty keeps the weights of rare ones small.
    Clean documents have grade 0, as have their windows; toxic ones grade 1
    to ``grades`` by how much of them consists of features that toxic documents have ten times as often.
    At most ``sample_rows`` labelled documents and ``n_features`` features reach the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # at most sample_rows ids
    counted = T.StructType([T.StructField("feature", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = (Counter(), Counter())
        for text, label in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
            seen[int(label > 0)].update({f for w in set(_WORD.findall(text.lower())) for f in names_of(w)})
        both = list(seen[0] | seen[1])
        return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *[pa.array([c[f] for f in both], pa.int64()) for c in (seen[1], seen[0])]], counted.names)

    sizes = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1)).alias("t"), F.sum(F.when(F.col("toxic") <= 0, 1)).alias("c")).first()
    if not sizes["t"] or not sizes["c"]:
        return Model({}, np.zeros(0), np.array([math.inf]))
    t, c = float(sizes["t"]), float(sizes["c"])
    found = map_texts(sample.select("doc_id", "text", "toxic"), count, counted).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    gain = F.expr(f"a * ln((a + 0.5) * {c} / ((b + 0.5) * {t}))")
    found = found.where(f"a * {c} > 3 * b * {t}").orderBy(gain.desc(), "feature").limit(n_features).collect()
    features = {r["feature"]: i for i, r in enumerate(found)}
    strong = {features[r["feature"]] for r in found if r["a"] * c > 10 * r["b"] * t}
    entry = T.StructType([T.StructField("label", T.LongType()), T.StructField("places", T.ArrayType(T.LongType())),
                          T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("share", T.DoubleType())])

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, rows = _Table(features), []
        for text, label in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
            words = _WORD.findall(text.lower())
            whole, windows, _ = window_counts(words, table)
            share = sum(any(p in strong for p in table[w]) for w in words) / max(1, len(words))
            rows.append((int(label > 0), list(whole), _values(whole, len(words)), share))
            if label <= 0:
                alike = {tuple(sorted(c.items())): c for c in windows}
                rows.extend((-1, list(c), _values(c, WINDOW), 0.0) for c in alike.values())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()))], entry.names)

    seen = map_texts(sample.select("doc_id", "text", "toxic"), vectors, entry).collect()  # at most sample_rows and the unlike windows of the clean ones, features of the model only
    label, share = np.array([r["label"] for r in seen]), np.array([r["share"] for r in seen])
    grade = np.zeros(len(seen), np.int64)
    bounds = np.quantile(share[label == 1], np.arange(1, grades) / grades)
    grade[label == 1] = 1 + np.searchsorted(bounds, share[label == 1], side="right")
    rows = np.repeat(np.arange(len(seen)), [len(r["places"]) for r in seen])
    places = np.array([p for r in seen for p in r["places"]], np.int64)
    values = np.array([v for r in seen for v in r["values"]])
    weights, thresholds = fit_ordinal(rows, places, values, grade, max(1, len(features)), documents=int((label >= 0).sum()))
    return Model(features, weights, thresholds)


def _judge(docs: DataFrame, model: Model, limit: float) -> tuple[Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType]:
    schema = T.StructType([id_field(docs), T.StructField("score", T.DoubleType()), T.StructField("expected_severity", T.DoubleType()),
                           T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    table = _Table(model.features)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([highest_score(_WORD.findall(text.lower()), table, model.weights) for text in texts_of(batch)], np.float64)
        above = model.above(scores)
        severity = above.sum(1)
        toxic = severity >= limit
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(severity), pa.array((above >= 0.5).sum(1).astype(np.int32)),
                                           pa.array(toxic), pa.array(~toxic)], schema.names)

    return work, schema


#: Expected severity from which a document counts as toxic.
SEVERITY_LIMIT = 0.3


def toxicity_scores(docs: DataFrame, model: Model, limit: float = SEVERITY_LIMIT) -> DataFrame:
    """Score, expected severity (the sum of the chances to lie above each threshold), most fitting grade and verdict of each whole text.

    The whole text and all its windows of ``WINDOW`` words are scored and the highest score counts, so a
    toxic passage weighs as much in a long text as alone.

    A null or empty text has no features and score 0; repeated rows are judged one by one; an empty
    table gives no rows; a null id is carried along; columns other than doc_id and text are not read.
    A model fitted without toxic or without clean labels calls nothing toxic.
    """
    return map_texts(docs.select("doc_id", "text"), *_judge(docs, model, limit))


def keep_by_toxicity(docs: DataFrame, model: Model, limit: float = SEVERITY_LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    return filter_texts(docs, _judge(docs, model, limit)[0], "kept")
