"""Vector arithmetic.

Products are taken in float and summed in double.  Pairs of rows go to NumPy as columns: an expression for
each number of each pair costs many times as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from foliant.functions.text import col


def norm(v: Column | str) -> Column:
    """Euclidean length; 0 for an empty vector."""
    return F.sqrt(F.aggregate(F.transform(col(v), lambda x: (x * x).cast("double")), F.lit(0.0),
                              lambda acc, x: acc + x))


def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise dot product of two float lists straight from the Arrow buffers."""
    oa, ob = (np.asarray(x.offsets, dtype=np.int64) for x in (a, b))
    va, vb = (np.asarray(x.values, dtype=np.float32) for x in (a, b))
    la, lb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(a))
    n = len(a)
    if n and (la == la[0]).all() and (lb == la[0]).all() and la[0] > 0:
        d = int(la[0])
        ma = va[oa[0]:oa[0] + n * d].reshape(n, d)
        mb = vb[ob[0]:ob[0] + n * d].reshape(n, d)
        out = (ma * mb).sum(axis=1, dtype=np.float64)
    else:
        for i in np.flatnonzero((la == lb) & (la > 0)):
            out[i] = (va[oa[i]:oa[i] + la[i]] * vb[ob[i]:ob[i] + la[i]]).sum(dtype=np.float64)
    return pa.array(out, type=pa.float64())


@F.arrow_udf(T.DoubleType())
def _dot_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _dot(a, b)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product through Arrow and NumPy; the fast path for many pairs."""
    empty = F.array().cast("array<float>")
    return _dot_udf(F.coalesce(col(a), empty), F.coalesce(col(b), empty))


def _plain(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of lists, where each list begins, and its length; -1 for a list that is missing or misses a value."""
    begin, values = np.asarray(x.offsets, dtype=np.int64), x.values
    length = np.diff(begin)
    if x.null_count:
        length = np.where(np.asarray(x.is_valid()), length, -1)
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
        length = np.where(gaps[begin[1:]] > gaps[begin[:-1]], -1, length)
    return values.to_numpy(zero_copy_only=False), begin[:-1], length


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of columns, added up in double one after the other."""
    total = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of each pair of rows; 0 for empty, zero, missing or differently sized vectors."""
    (va, ba, la), (vb, bb, lb) = _plain(a), _plain(b)
    out = np.zeros(len(la))
    with np.errstate(all="ignore"):
        for d in np.unique(la[(la == lb) & (la > 0)]):
            at = np.flatnonzero((la == d) & (lb == d))
            x, y = (np.ascontiguousarray(v[begin[at][:, None] + np.arange(d)].T) for v, begin in ((va, ba), (vb, bb)))
            size_x, size_y = (np.sqrt(_in_order(z, z)) for z in (x, y))
            out[at] = np.where((size_x <= 0) | (size_y <= 0), 0.0, _in_order(x, y) / (size_x * size_y))
    return pa.array(out, type=pa.float64())


#: Pairs of ``all_cosines`` whose products are held at a time.
PAIRS = 1 << 16


def all_cosines(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, cosines) of all pairs, batch by batch: the figures of ``cosine_similarity``, with each length taken once."""
    (va, ba, la), (vb, bb, lb) = _plain(a), _plain(b)
    for d in np.unique(la):
        at, same = np.flatnonzero(la == d), np.flatnonzero((lb == d) & (d > 0))
        rest = np.flatnonzero((lb != d) | (d <= 0))
        for s in range(0, len(at) if len(rest) else 0, step := max(1, PAIRS // max(len(rest), 1))):
            some = at[s:s + step]
            yield np.repeat(some, len(rest)), np.tile(rest, len(some)), np.zeros(len(some) * len(rest))
        if not len(same):
            continue
        x, y = (np.ascontiguousarray(v[begin[i][:, None] + np.arange(d)].T) for v, begin, i in ((va, ba, at), (vb, bb, same)))
        with np.errstate(all="ignore"):
            size_x, size_y = (np.sqrt(_in_order(z, z)) for z in (x, y))
            step = max(1, PAIRS // len(same))
            for s in range(0, len(at), step):
                some = slice(s, s + step)
                total = np.zeros((len(at[some]), len(same)))
                for i in range(d):
                    total += np.multiply.outer(x[i, some], y[i])
                none = (size_x[some, None] <= 0) | (size_y <= 0)
                yield np.repeat(at[some], len(same)), np.tile(same, len(at[some])), np.where(none, 0.0, total / (size_x[some, None] * size_y)).ravel()


@F.arrow_udf(T.DoubleType())
def _cosines_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _cosines(a, b)


def cosine_from(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from its parts, 0 when either vector has no length."""
    return F.coalesce(F.when((norm_a > 0) & (norm_b > 0), dot_product / (norm_a * norm_b)), F.lit(0.0))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine through Arrow and NumPy, summed in the order of the numbers; 0 for empty, zero, missing or differently sized vectors."""
    return _cosines_udf(col(a), col(b))
