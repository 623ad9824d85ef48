"""Whitening by incremental eigendecomposition: rank-one updates in partitions, spectra merged, then one Rayleigh-Ritz step over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import stage
from foliant.llm.vector_topk import whole_vectors

#: Spectra, or sums, that one task merges.
FAN_IN = 32
_EPS = np.finfo(np.float64).eps
#: Cosine of two axes that are taken as turned by rounding.
_TURNED = 1e-13


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)), one right of each ascending pole: (root - pole for all pairs, roots).

    A root is found as a distance from its nearer pole, by matching both neighbouring poles, inside a
    bracket that halves where that fails.
    """
    k, zz = len(d), z * z
    gap = np.r_[d[1:] - d[:-1], zz.sum()]
    middle = d + gap / 2
    right = 1 + (zz / (d - middle[:, None])).sum(1) < 0
    right[-1] = False
    origin = np.arange(k) + right
    poles = d[None, :] - d[origin][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    own = np.arange(k)
    x = (low + high) / 2
    for _ in range(100):
        away = poles - x[:, None]
        t = zz / away
        f = 1 + t.sum(1)
        slopes = t / away
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done = (np.abs(f) <= 8 * _EPS * (1 + np.abs(t).sum(1))) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        left = np.tril(slopes).sum(1)
        slope = slopes.sum(1)
        p, q = away[own, own], np.r_[away[own[:-1], own[1:]], np.inf]
        with np.errstate(all="ignore"):
            a, b, c = (p + q) * f - p * q * slope, p * q * f, f - p * left - q * (slope - left)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + slope[-1] * p[-1] ** 2 / (f[-1] - slope[-1] * p[-1])
            new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x = np.where(done, x, new)
    return x[:, None] - poles, d[origin] + x


def rank_one(values: np.ndarray, axes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of axes diag(values) axes' + v v'.

    Deflation: equal eigenvalues are turned so that one of them carries v's part, and eigenvectors that v
    hardly touches stay.  The others move to the roots of the secular equation; the vector is made anew
    from the roots, so that the new eigenvectors stand at right angles whatever the roots' last bits.
    """
    z = axes.T @ v
    size = z @ z
    if not size:
        return values, axes
    tolerance = 8 * _EPS * max(values[-1], size)
    axes = axes.copy()
    clusters = np.flatnonzero(np.r_[True, np.diff(values) > tolerance, True])
    for a, b in zip(clusters[:-1], clusters[1:], strict=True):
        length = np.sqrt(z[a:b] @ z[a:b])
        if b - a > 1 and length:
            h = z[a:b].copy()
            h[-1] += np.copysign(length, h[-1])
            h /= np.sqrt(h @ h)
            axes[:, a:b] -= 2 * np.outer(axes[:, a:b] @ h, h)
            z[a:b] = np.r_[np.zeros(b - a - 1), -np.copysign(length, z[b - 1])]
    moved = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(moved):
        return values, axes
    d, values = values[moved], values.copy()
    beyond, roots = secular_roots(d, z[moved])
    k = len(d)
    apart = d[:, None] - d[None, :]
    apart = np.where(np.tri(k, k=-1, dtype=bool).T, apart, np.r_[apart[1:], np.ones((1, k))])  # root i over pole i before the diagonal, over pole i + 1 from it on
    weights = np.copysign(np.sqrt(np.abs(np.prod(beyond / apart, 0))), z[moved])
    turn = (weights / beyond).T
    axes[:, moved] = axes[:, moved] @ (turn / np.sqrt((turn * turn).sum(0)))
    values[moved] = roots
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0), axes[:, order]


class Spectrum:
    """Rows seen so far: how many, their exact sums, and the eigendecomposition of their centred squares."""

    def __init__(self, dims: int, n: int = 0, sums: list[int] | None = None, values: np.ndarray | None = None, axes: np.ndarray | None = None) -> None:
        self.n, self.sums = n, sums or [0] * dims
        self.values = np.zeros(dims) if values is None else values
        self.axes = np.eye(dims) if axes is None else axes

    def update(self, v: np.ndarray) -> None:
        self.values, self.axes = rank_one(self.values, self.axes, v)

    def moved(self, n: int, sums: list[int]) -> None:
        """The rank-one part that stands between the means of the rows seen and of ``n`` others; then counts them."""
        if self.n and n:
            between = np.array([a * n - b * self.n for a, b in zip(self.sums, sums, strict=True)], np.float64)
            self.update(between / np.sqrt(float(self.n) * n * (self.n + n)))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def square(self) -> None:
        """Puts axes back at right angles where rounding has turned them, each against those of larger values, which stay."""
        if np.abs(self.axes.T @ self.axes - np.eye(len(self.axes))).max(initial=0) > _TURNED:
            q, r = np.linalg.qr(self.axes[:, ::-1])
            self.axes = (q * np.copysign(1.0, np.diag(r)))[:, ::-1]

    def add(self, rows: np.ndarray) -> None:
        """Rows of whole numbers.  More rows than dimensions go in as the triangular factor of their centred matrix, row by row."""
        sums = [int(s) for s in rows.sum(0, dtype=object)] if np.abs(rows).max(initial=0) * len(rows) >= 2.0**53 else [int(s) for s in rows.sum(0)]
        centred = rows - np.array([s // len(rows) for s in sums], np.float64) - np.array([s % len(rows) for s in sums], np.float64) / len(rows)
        for v in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
            self.update(v)
        self.moved(len(rows), sums)
        self.square()

    def merge(self, other: Spectrum) -> None:
        for value, axis in zip(other.values, other.axes.T, strict=True):
            if value > 0:
                self.update(np.sqrt(value) * axis)
        self.moved(other.n, other.sums)
        self.square()


def _per_partition(rows: DataFrame, dims: int, scale: float, work: Callable[[Iterator[np.ndarray]], dict | None], schema: str) -> DataFrame:
    """One row a partition by ``work`` over its vectors' whole numbers, as (slot, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = None

        def found() -> Iterator[np.ndarray]:
            nonlocal slot
            for batch in batches:
                if batch.num_rows:
                    slot = batch.column(1)[0].as_py()
                    for size, _, values in whole_vectors(batch.column(0), scale):
                        if size == dims:
                            yield values

        out = work(found())
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"slot": slot, **out}], pa.schema([("slot", pa.int64()), *_arrow(out)]))

    return rows.select("embedding", F.spark_partition_id().alias("slot")).mapInArrow(run, schema)


def _arrow(out: dict) -> list[tuple[str, pa.DataType]]:
    return [(k, pa.int64() if isinstance(v, int) else pa.list_(pa.int64() if isinstance(v, list) else pa.float64())) for k, v in out.items()]


def _merged(states: DataFrame, merge: Callable[[pd.DataFrame], dict]) -> dict | None:
    """One state from those of the partitions, FAN_IN at a time; only the last, of the size of one, reaches the driver."""
    states = stage(states)
    top = states.agg(F.max("slot")).first()[0]
    if top is None:
        return None
    schema = states.schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out = merge(group.sort_values("slot"))
        return pd.DataFrame([{"slot": group["slot"].iat[0] // FAN_IN, **out}])[schema.names]

    while top > 0:
        states = stage(states.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInPandas(fold, schema))
        top //= FAN_IN
    return states.first().asDict()


def _spectrum(row: dict | pd.Series) -> Spectrum:
    dims = len(row["sums"])
    return Spectrum(dims, int(row["n"]), [int(s) for s in row["sums"]], np.array(row["values"], np.float64), np.array(row["axes"], np.float64).reshape(dims, dims))


def _state(s: Spectrum) -> dict:
    return {"n": s.n, "sums": s.sums, "values": s.values, "axes": s.axes.ravel()}


def _added(group: pd.DataFrame) -> dict:
    return {"squares": np.sum(np.stack([np.asarray(x, np.float64) for x in group["squares"]]), 0)}


def _squares(rows: DataFrame, dims: int, scale: float, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of the products of the projected rows, over all partitions."""

    def work(parts: Iterator[np.ndarray]) -> dict | None:
        total = None
        for values in parts:
            y = project(values)
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else {"squares": total.ravel()}

    found = np.array(_merged(_per_partition(rows, dims, scale, work, "slot long, squares array<double>"), _added)["squares"])
    return found.reshape(2 * [round(len(found) ** 0.5)])


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """Principal components with variance one: a row per vector and component, x = floor(scale * entry) + shift.

    Each partition keeps the eigendecomposition of its centred rows and updates it by rank-one
    steps (``rank_one``); a batch with more rows than dimensions is first reduced to the triangular factor of its
    centred matrix, whose rows are the updates.  Two spectra are merged by as many rank-one steps as there are
    dimensions and one for the distance of the means.  A last pass projects all rows on the merged
    eigenvectors, adds up the products and turns the vectors once more (Rayleigh-Ritz), which brings
    them to double precision; another measures the whitened covariance.  Sums are exact whole numbers, rows are centred
    before anything is multiplied, and what tasks and the driver hold is of the size dimensions squared.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and those of another length than most
    (of the shorter one in a tie).  Components without variance (the rest of rounding) are left out, so a single
    vector, or equal ones, have no rows.  Repeated rows count one by one, a null vec_id is carried along; an empty table gives no
    rows; columns other than vec_id and embedding are not read.  A deviation beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select("vec_id", "embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    lengths = rows.where((F.size("embedding") > 0) & whole).groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.col("n").desc(), "dims").first()
    if most is None:
        return spark.createDataFrame([], out)
    dims = most["dims"]

    def track(parts: Iterator[np.ndarray]) -> dict | None:
        seen = Spectrum(dims)
        for values in parts:
            seen.add(values)
        return _state(seen) if seen.n else None

    def merge(group: pd.DataFrame) -> dict:
        first, *others = [_spectrum(row) for _, row in group.iterrows()]
        for other in others:
            first.merge(other)
        return _state(first)

    seen = _spectrum(_merged(_per_partition(rows, dims, scale, track, "slot long, n long, sums array<long>, values array<double>, axes array<double>"), merge))
    n, base = seen.n, np.array([s // seen.n for s in seen.sums], np.float64)
    over = [s % seen.n for s in seen.sums]
    part = np.array([r / n for r in over], np.float64)
    axes = np.linalg.qr(seen.axes)[0]
    values, turn = np.linalg.eigh(_squares(rows, dims, scale, lambda x: (x - base - part) @ axes) / n)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], (axes @ turn)[:, order]
    top = min(components, int(np.count_nonzero(values > dims * _EPS * max(values[0], 0))))
    if not top:
        return spark.createDataFrame([], out)
    explained, turned = values[:top] / values.sum(), axes[:, :top] / np.sqrt(values[:top])
    error = float(np.abs(_squares(rows, dims, scale, lambda x: (x - base - part) @ turned) / n - np.eye(top)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            for size, at, values in whole_vectors(batch.column(1), scale):
                for start in range(0, len(at) if size == dims else 0, 4096):
                    x, ids = values[start:start + 4096] - base, batch.column(0).take(pa.array(at[start:start + 4096]))
                    rows = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.repeat(np.arange(rows), top))), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), rows)), pa.array(np.full(rows * top, n)),
                         pa.array(np.repeat(_deviation(x, n, over), top)), pa.array(((x - part) @ turned).ravel()), pa.array(np.tile(explained, rows)),
                         pa.array(np.full(rows * top, error))], names)

    return rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(run, out)


def _deviation(x: np.ndarray, n: int, over: list[int]) -> np.ndarray:
    """Sums over the dimensions of (n x - S)^2, x less its whole mean and S less n times it; exact."""
    if (np.abs(x).max(initial=0) + 1) ** 2 * float(n) ** 2 * x.shape[1] < 2.0**62:
        return np.square(n * x.astype(np.int64) - np.array(over, np.int64)).sum(1)
    return np.array([sum((n * int(c) - r) ** 2 for c, r in zip(row, over, strict=True)) for row in x], np.int64)
