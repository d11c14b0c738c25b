"""Shared storage for tables and checkpoints that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every node sees, as the cluster names it.

    A local session without the setting gets a temporary folder. A cluster session
    without it is refused: a folder of one machine would lose data with the machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
        application = spark.sparkContext.applicationId
        if application not in _local_folders:
            _local_folders[application] = tempfile.mkdtemp(prefix="goldpan-")
        folder = _local_folders[application]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/goldpan-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, read back from files written once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on shared storage: later jobs read it, none recompute it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to a folder of their own: a checkpoint would compute them twice."""
    return written(df, new_folder(df.sparkSession))
