"""Folders that the driver and all executors share, for tables that are written and read again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of
    its own; on a cluster there is no safe choice, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, whatever file system it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def has_path(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, whatever file system it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared storage, deleted at the end; what leaves the block must have been checkpointed."""
    path = f"{shared_root(spark)}/tallyforge/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_path(spark, path)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df, written to a folder and read again: its lineage is cut, and a lost executor costs nothing that was done before."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
