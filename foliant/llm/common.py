"""Helpers shared by the training-text operators: staged tables, byte-bounded Arrow slices, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: UTF-8 bytes of text that a Python worker turns into words at a time.
SLICE_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this Python worker has learnt, by the name of the operator's table; one at most.
_LEARNT: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own for a local master.

    A cluster session that names no folder is an error: a machine-local one would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="foliant-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read as Parquet in the shared folder and read it back.

    Columnar files keep column pruning for the readers, cut the lineage, and survive lost executors.  Once the files are
    there nobody reads the shuffles that made them, so Spark is asked to remove those when the write has ended.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(staged: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more: what was made from it is staged itself."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("stage-"):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def worker_table(name: str, build: Callable[[], object]) -> object:
    """The table that a worker keeps under this name from slice to slice and task to task, built where it is missing."""
    if name not in _LEARNT:
        _LEARNT[name] = build()
    return _LEARNT[name]


def give_up_tables(but: str | None = None) -> None:
    """Drop the tables of other operators, as a worker serves one stage after another."""
    for name in [x for x in _LEARNT if x != but]:
        del _LEARNT[name]


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType,
              limit: int = SLICE_BYTES, table: str | None = None) -> DataFrame:
    """Run ``work`` on byte-bounded slices of (doc_id, text, ...); other columns of ``docs`` never reach Python.

    ``table`` names the ``worker_table`` that ``work`` uses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_tables(table)
        for batch in batches:
            for part in slices(batch, 1, limit):
                out = work(part)
                if out is not None:
                    yield out

    return docs.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], verdict: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns, whose ``verdict`` by ``work`` is true; decided where the text is read, without a join."""
    at = [docs.columns.index("doc_id"), docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_tables()
        for batch in batches:
            for part in slices(batch, at[1], limit):
                out = work(part.select(at))
                yield part.filter(out.column(out.schema.names.index(verdict)))

    return docs.mapInArrow(run, docs.schema)


def id_field(docs: DataFrame) -> T.StructField:
    return T.StructField("doc_id", docs.schema["doc_id"].dataType)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """Whole texts of a slice; a null text is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def anchors(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node of a block reaches over the links (places a, b) found in the block."""
    out, before = nodes.copy(), None
    while before is None or (out != before).any():
        before = out.copy()
        np.minimum.at(out, a, before[b])
        np.minimum.at(out, b, before[a])
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that is not its component's smallest node, from edges (a, b).

    Alternating large-star and small-star steps: each node is linked to the smallest neighbour until
    only stars are left, in a number of rounds that grows with the logarithm of the diameter.  Minima
    are combined before the shuffle and a hub's edges are dealt out by the join, so no task gathers
    a whole component.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        nearest = edges.select("u", "v").union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
        nearest = nearest.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(nearest, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stage(small.union(least.select("u", "m")).distinct())
        unstage(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
