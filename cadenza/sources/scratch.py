"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; set to a fresh folder only where it is unset and Spark runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/cadenza/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for joins by sort and merge, whatever its size.

    For tables that grow with the input: Spark judges a stored table by its compressed file, however many rows are made
    of it before the join, and would send it through the driver.
    """
    return df.hint("merge")
