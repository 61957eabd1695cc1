"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one temporary folder of the application where it is
    unset, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def stage(df: DataFrame) -> DataFrame:
    """The frame written as Parquet and read again: its lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def unstage(table: DataFrame) -> None:
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
