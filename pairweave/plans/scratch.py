"""Cutting lineage of iterative plans in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CREATED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a session on one machine (tests) gets a temporary folder; on a
    cluster it is an error, as executors would write to their own disks.
    """
    path = kept_folder(spark)
    _CREATED.append((spark, path))
    return path


def kept_folder(spark: SparkSession) -> str:
    """The same, for files that stay when the session ends."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairweave-"))
        base = context.getCheckpointDir()
    return f"{_qualified(spark, base).rstrip('/')}/pairweave/{uuid.uuid4().hex}"


def _qualified(spark: SparkSession, path: str) -> str:
    """A plain path with the file system that Spark takes it for, so that tasks that open files themselves mean the same."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_folder``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _CREATED:
        try:
            if spark.sparkContext._jsc is not None:
                drop_folder(spark, path)
        except Exception:  # the session has ended; the folder stays for its owner to clear
            return


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into shared space and read it back.

    Cuts lineage as a reliable checkpoint does, but computes its input once; it survives lost executors.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
