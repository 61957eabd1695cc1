"""Staging of intermediate tables, bounded samples and sized broadcasts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir

#: A side of at most so many bytes may be broadcast, and a row of a few keys counts as so many.
BROADCAST_BYTES = 32_000_000
ROW_BYTES = 64
BROADCAST_ROWS = BROADCAST_BYTES // ROW_BYTES


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, as texts may be long. The setting stays, as frames are planned when their
    caller acts on them; it changes no rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Shuffle files of a write inside go when it is over; afterwards the setting is as it was. It must
    not outlast the write: a frame that is read by `toLocalIterator` under it can lose its shuffle
    before the read, and then has no rows."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Stages:
    """Intermediate tables as Parquet in the shared folder: they cut lineage, survive a lost
    executor, and `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
        self.count = 0
        prepare(spark)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with clean_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._staged_at = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._staged_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, rows: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """A broadcast hint where the counted rows, of `row_bytes` each at most, are small; else the frame
    as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores as long as a column of the frame is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """All rows if there are at most `bound`; else about `bound` of them, chosen by a hash of `key`."""
    total = df.count()
    if total <= bound:
        return df
    share = int(2**31 * bound / total)
    return df.where(F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit(2**31 - 1)) < F.lit(share))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(by)
