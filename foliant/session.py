"""Session defaults and cluster-aware helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "foliant", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Adaptive execution stays on so that shuffle partitions are coalesced, hot
    join keys are split and small build sides are broadcast on *measured* size.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # array<float> batches are wide: keep an Arrow batch to tens of MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, whose functions import it by name."""
    if "foliant.zip" not in str(spark.sparkContext._python_includes):
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="foliant-package-")
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "foliant"), "zip", os.path.dirname(root), os.path.basename(root)))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting (tests, bench) gets a folder of its
    own; a cluster session without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for a small result that several later steps read."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_columns(df: DataFrame) -> DataFrame:
    """The same for a large result: Parquet in the shared folder, so that each later step reads only its columns."""
    path = f"{_checkpoint_folder(df.sparkSession).rstrip('/')}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
