"""Exact top-k by inner product: vectors in vertical blocks, scored dimensions by dimensions, with bounds on what is left."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from foliant.llm.common import stage
from foliant.plans.ranking import top_per_group

#: Components of a block of candidates, and of a block of queries.
BLOCK_VALUES, QUERY_VALUES = 1 << 19, 1 << 21
#: Blocks of candidates that a task meets a block of queries with.
BUCKET_BLOCKS = 16
#: Queries scored at a time, dimensions added at a time, and queries whose scores seed the thresholds.
TILE, STEP, SEEDS = 128, 16, 4096
#: The share of pairs alive below which they are scored one by one.
SPARSE = 0.04
_NONE = np.iinfo(np.int64).min
_BLOCK = "block long, dims int, rows int, ids array<long>, known array<boolean>, kind string, matrix binary"


def whole_vectors(column: pa.ListArray, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, floor(scale * component) as float64) of the vectors without null or non-finite components, by their length."""
    values = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]
    ends = np.cumsum(lengths)
    whole = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    for dims in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == dims))
        yield int(dims), rows, np.floor(scale * numbers[(ends[rows] - dims)[:, None] + np.arange(dims)])


def integers(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them; those beyond 64 bits are an error."""
    top = np.abs(values).max(initial=0)
    if top >= 2.0**63:
        raise OverflowError("a component times the scale does not fit 64 bits")
    return values.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def _packed(rows: DataFrame, scale: float, values: int) -> DataFrame:
    """Rows (vec_id, embedding, part) as blocks: ids, and the components dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        made = 0

        def block(dims: int, part: int) -> pa.RecordBatch:
            nonlocal made
            ids, matrix = zip(*waiting.pop(dims), strict=True)
            matrix = np.ascontiguousarray(np.concatenate([m.astype(np.result_type(*matrix)) for m in matrix]).T)
            made += 1
            ids, one = pa.concat_arrays(ids), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32()), one(pc.fill_null(ids, 0)), one(ids.is_valid()),
                 pa.array([matrix.dtype.str]), pa.array([matrix.tobytes()], pa.binary())], ["block", "dims", "rows", "ids", "known", "kind", "matrix"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for dims, at, found in whole_vectors(batch.column(1), scale):
                room = max(1, values // dims)
                for start in range(0, len(at), room):
                    waiting.setdefault(dims, []).append((batch.column(0).take(pa.array(at[start:start + room])).cast(pa.int64()), integers(found[start:start + room])))
                    if sum(len(m) for _, m in waiting[dims]) >= room:
                        yield block(dims, part)
        for dims in list(waiting):
            yield block(dims, part)

    return rows.select("vec_id", "embedding", F.spark_partition_id().alias("part")).mapInArrow(run, _BLOCK)


class _Block:
    """Vectors of a block, dimension by dimension, with their ids and whether these are known."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.matrix, self.ids, self.known = matrix, ids, known
        self.energy = np.square(matrix.astype(np.float64))
        self.reach = math.sqrt(self.energy.sum(0).max(initial=0))

    @classmethod
    def of(cls, row: pd.Series) -> _Block:
        matrix = np.frombuffer(row["matrix"], row["kind"]).reshape(row["dims"], row["rows"])
        return cls(matrix, np.asarray(row["ids"], np.int64), np.asarray(row["known"], bool))

    def first(self, n: int) -> _Block:
        return _Block(self.matrix[:, :n], self.ids[:n], self.known[:n])


class _Best:
    """The best k of each query: scores, ids and whether the id is known."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), _NONE, np.int64)
        self.id, self.known = np.zeros((queries, k), np.int64), np.zeros((queries, k), bool)
        self.k = k

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        touched = np.unique(q)
        held = self.score[touched] != _NONE
        all_q = np.r_[q, np.repeat(touched, held.sum(1))]
        score, ids, known = np.r_[score, self.score[touched][held]], np.r_[ids, self.id[touched][held]], np.r_[known, self.known[touched][held]]
        order = np.lexsort((ids, ~known, -score, all_q))
        all_q, score, ids, known = all_q[order], score[order], ids[order], known[order]
        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        first = rank < self.k
        self.score[touched] = _NONE
        self.score[all_q[first], rank[first]] = score[first]
        self.id[all_q[first], rank[first]], self.known[all_q[first], rank[first]] = ids[first], known[first]


def _remaining(block: _Block, order: np.ndarray, steps: int) -> list[np.ndarray]:
    """The norm of what follows each step but the last, a little more than less."""
    tail = np.cumsum(block.energy[order[::-1]], 0)
    return [np.sqrt(tail[len(order) - (s + 1) * STEP - 1]) * 1.000001 + 1e-6 for s in range(steps - 1)]


def _meet(queries: _Block, candidates: _Block, floors: np.ndarray, best: _Best) -> None:
    """Add the candidates that are among the best of their query so far and reach its floor.

    Scores grow by ``STEP`` dimensions at a time, those with most mass first.  What the others can still
    add is at most the product of both remaining norms: pairs that can't reach the query's
    threshold with it are dropped, candidates that no query of the tile can use are cut out of the
    columns, and once few pairs are left they are scored one by one.
    """
    bits = math.log2(max(queries.reach * candidates.reach, 1)) + 1
    if bits >= 63:
        raise OverflowError("a score does not fit 64 bits")
    exact = np.float32 if bits < 24 else np.float64 if bits < 53 else np.int64  # sums of products stay whole numbers
    order = np.argsort(-candidates.energy.sum(1), kind="stable")
    steps = [order[s:s + STEP] for s in range(0, len(order), STEP)]
    rest_q, rest_c = _remaining(queries, order, len(steps)), _remaining(candidates, order, len(steps))
    columns = [candidates.matrix[s].astype(exact) for s in steps]
    rows = [np.ascontiguousarray(queries.matrix[s].T).astype(exact) for s in steps]
    for start in range(0, len(queries.ids), TILE):
        end = min(start + TILE, len(queries.ids))
        threshold = np.maximum(floors[start:end], best.score[start:end, -1])
        q, c, score = _survivors([x[start:end] for x in rows], columns, [x[start:end] for x in rest_q], rest_c, threshold)
        q = q + start
        other = ~(queries.known[q] & candidates.known[c] & (queries.ids[q] == candidates.ids[c]))
        other &= (score > best.score[q, -1]) | ~best.known[q, -1] | (candidates.ids[c] < best.id[q, -1])  # ties that come too late
        if other.any():
            best.add(q[other], score[other].astype(np.int64), candidates.ids[c[other]], candidates.known[c[other]])


def _survivors(rows: list[np.ndarray], columns: list[np.ndarray], rest_q: list[np.ndarray], rest_c: list[np.ndarray],
               threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and whole scores of the pairs that reach the threshold of their query."""
    alive, exact = np.arange(columns[0].shape[1]), columns[0].dtype
    q = c = None
    score = np.zeros((len(threshold), len(alive)), exact)
    floating = np.float32 if exact == np.float32 else np.float64
    loose = (threshold - np.abs(threshold.astype(np.float64)) / 1e9 - 1).astype(floating)  # beyond what bounds lose by rounding
    for s, (x, y) in enumerate(zip(rows, columns, strict=True)):
        last = s == len(rows) - 1
        if q is None:
            score += x @ (y if len(alive) == y.shape[1] else y[:, alive])
            reach = score >= threshold[:, None] if last else score + np.multiply.outer(rest_q[s].astype(floating), rest_c[s][alive].astype(floating)) >= loose[:, None]
            if last or np.count_nonzero(reach) <= SPARSE * reach.size:
                q, c = np.nonzero(reach)
                score, c = score[q, c], alive[c]
            else:
                some = reach.any(0)
                if not some.all():
                    alive, score = alive[some], score[:, some]
        else:
            score = score + np.einsum("ij,ji->i", x[q], y[:, c])
            kept = score >= threshold[q] if last else score + rest_q[s][q] * rest_c[s][c] >= loose[q]
            q, c, score = q[kept], c[kept], score[kept]
    return q, c, score


def _compare(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of each query of a block among the candidates of a bucket of blocks.

    A query's floor is its k-th best score among the first queries of its block: as these are rows, too,
    its k-th best of all is no lower.
    """
    found = []
    for _, row in group[group["asks"]].iterrows():
        queries = _Block.of(row)
        seeds, best = _Best(len(queries.ids), k), _Best(len(queries.ids), k)
        _meet(queries, queries.first(SEEDS), seeds.score[:, -1].copy(), seeds)
        for _, other in group[~group["asks"]].iterrows():
            _meet(queries, _Block.of(other), seeds.score[:, -1], best)
        q, r = np.nonzero(best.score != _NONE)
        found.append(pd.DataFrame({"block": np.full(len(q), row["block"]), "place": q, "query_id": queries.ids[q], "vec_id": best.id[q, r],
                                   "known": best.known[q, r], "score": best.score[q, r]}))
    return pd.concat(found)


def top_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all rows but its own: (query_id, rank, vec_id, score).

    Components count as floor(scale * component).  Rows of ``vectors`` and of ``queries`` (vec_id, embedding) are packed where
    they are read into blocks that hold one dimension after another.  Query blocks meet buckets of
    candidate blocks, each pair of a query block and a bucket in one task that returns ``k`` rows a query at most;
    inside, branch and bound (``_meet``) with thresholds seeded by the scores among the queries.  Ties go to the smaller vec_id, a null one last.

    Vectors that are null, empty or hold null or non-finite components take no part; vectors of different
    lengths are not compared; a query without a vec_id is none.  Its own are all rows with the query's
    vec_id; repeated rows count one by one, as queries too; an empty table gives no rows; columns
    other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    asked = queries.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    dims = max(1, asked.agg(F.max(F.size("embedding"))).first()[0] or 1)
    count = asked.count()
    parts = max(1, math.ceil(count * dims / QUERY_VALUES))
    asks = stage(_packed(asked.repartition(parts), scale, QUERY_VALUES).withColumn("asks", F.lit(True)))
    blocks = stage(_packed(vectors.where("embedding is not null").select("vec_id", "embedding"), scale, BLOCK_VALUES).withColumn("asks", F.lit(False)))
    numbers = asks.select("dims", "block").withColumn("i", F.row_number().over(Window.partitionBy("dims").orderBy("block")))
    many = {r["dims"]: r["n"] for r in asks.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = spark.sparkContext.defaultParallelism
    held = blocks.count()
    buckets = max(1, math.ceil(held / BUCKET_BLOCKS), min(held, math.ceil(2 * wide / sum(many.values()))))
    number = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    left = asks.join(numbers, ["dims", "block"]).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    right = blocks.where(F.col("dims").isin(*many)).withColumn("i", F.explode(F.sequence(F.lit(1), number[F.col("dims")].cast("int"))))
    right = right.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    names = ["dims", "i", "bucket", "asks", "block", "rows", "ids", "known", "kind", "matrix"]
    pairs = left.select(*names).unionByName(right.select(*names)).groupBy("dims", "i", "bucket")
    found = pairs.applyInPandas(lambda group: _compare(group, k), "block long, place long, query_id long, vec_id long, known boolean, score long")
    found = found.withColumn("vec_id", F.expr("if(known, vec_id, null)"))
    best = top_per_group(found, ["block", "place"], [F.col("score").desc(), F.col("vec_id").asc_nulls_last()], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
