"""Near-duplicate vectors: rotated one-bit codes with correction factors bound the cosine, close pairs are recomputed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import anchors, connected_components, stage

#: Vectors of a block; a task compares two blocks.
BLOCK_ROWS = 1024


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits, correction factor, rotated unit vectors).

    The factor is the inner product of a rotated unit vector with its code, the vertex of the cube
    (+-1/sqrt(d), ...) nearest to it.
    """
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    turned = unit @ rotation(vectors.shape[1]).T
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(vectors.shape[1]), turned


def estimates(bits: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated unit vectors (columns)."""
    signs = np.where(bits, 1.0, -1.0) / math.sqrt(bits.shape[1])
    return (signs @ turned.T) / factors[:, None]


def least_estimate(factors: np.ndarray, dims: int, threshold: float, confidence: float | None) -> np.ndarray:
    """The lowest estimate that a pair at the threshold can have, for each coded vector.

    A vector at cosine c differs from the coded one by a part of length sqrt(1 - c^2) at a right angle
    to it, whose product with the code is at most sqrt(1 - factor^2), and about that divided by
    sqrt(d - 1) for a random rotation.  ``confidence`` counts such standard errors; without it the
    bound is the certain one, and no pair at the threshold is ever left out.
    """
    spread = np.sqrt(np.maximum(0, 1 - factors**2)) / factors * math.sqrt(1 - threshold**2)
    if confidence is not None and dims > 1:
        spread *= min(1.0, confidence / math.sqrt(dims - 1))
    return threshold - spread - 1e-9


def _links(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float, confidence: float | None) -> pd.DataFrame:
    """Links between two blocks: per vector how many rows it links with, and the smallest id it is joined to here."""
    x, y = np.array(left["vector"].tolist(), np.float64), np.array(right["vector"].tolist(), np.float64)
    dims = x.shape[1]
    bits = np.unpackbits(np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1), axis=1)[:, :dims].astype(bool)
    factors = left["factor"].to_numpy()
    turned = (y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]) @ rotation(dims).T
    near = estimates(bits, factors, turned) >= least_estimate(factors, dims, threshold, confidence)[:, None]
    if same:
        near &= np.tri(len(left), k=-1, dtype=bool).T
    a, b = np.nonzero(near)
    norm_x, norm_y = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[k:k + 65536]], y[b[k:k + 65536]]) for k in range(0, len(a), 65536)] or [np.empty(0)])
    linked = exact / (norm_x[a] * norm_y[b]) >= threshold
    a, b = a[linked], b[linked]
    nodes = np.r_[left["node"].to_numpy(), right["node"].to_numpy()]
    copies = np.r_[left["copies"].to_numpy(), right["copies"].to_numpy()]
    b = b + len(left) if not same else b
    links = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
    anchor = anchors(nodes, a, b)
    kept = links > 0
    return pd.DataFrame({"node": nodes[kept], "links": links[kept].astype(np.int64), "anchor": anchor[kept]})


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, confidence: float | None = None,
                           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Link vectors of equal label with a cosine of ``threshold`` or more; components and kept representatives.

    Equal vectors are compared once.  Each label's vectors are dealt to blocks of about ``block_rows`` by
    a hash, and a task compares two blocks: estimates from the codes of one and the rotated vectors of
    the other discard pairs whose bound lies below the threshold, and the rest are recomputed in double
    precision.  A task returns one row per linked vector, its number of links and the smallest vector
    it is joined to, never the pairs, so a block of copies stays small.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
    label or id, link with nothing; vectors of different lengths are not compared.  Repeated rows of a
    vector link with one another; an empty table gives no rows; other columns are not read.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    valid = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
             & F.exists("vector", lambda x: x != 0))
    rows = stage(rows.select("vec_id", "label", F.when(valid, F.col("vector")).alias("vector"),
                             F.when(valid, F.xxhash64("vector")).alias("h1"), F.when(valid, F.xxhash64(F.lit(1), "vector")).alias("h2")))
    classes = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = stage(_with_codes(classes.withColumn("dims", F.size("vector"))))
    blocks = classes.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iat[0], group["j"].iat[0]
        left = group[group["own"] == i]
        right = left if i == j else group[group["own"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "links": [], "anchor": []}).astype("int64")
        return _links(left, right, i == j, threshold, confidence)

    found = dealt.select("label", "dims", "i", "j", "own", "node", "copies", "vector", "code", "factor")
    found = stage(found.groupBy("label", "dims", "i", "j").applyInPandas(compare, "node long, links long, anchor long"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("anchor").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("label", "h1", "h2", "node", "copies").join(links, "node", "left").join(components, "node", "left")
    out = rows.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "node", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _with_codes(classes: DataFrame) -> DataFrame:
    """Adds ``code`` (packed sign bits) and ``factor``, computed once per distinct vector."""
    names = classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(names.index("vector"))
            values, ends = vectors.flatten().to_numpy(), np.cumsum([len(v) for v in vectors])
            sizes = np.diff(np.r_[0, ends])
            codes, factors = [None] * len(sizes), np.zeros(len(sizes))
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                bits, factors[at], _ = encode(values[(ends[at] - dims)[:, None] + np.arange(dims)])
                for row, code in zip(at, np.packbits(bits, axis=1), strict=True):
                    codes[row] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)], [*names, "code", "factor"])

    return classes.mapInArrow(run, classes.withColumn("code", F.lit(None).cast("binary")).withColumn("factor", F.lit(0.0)).schema)
