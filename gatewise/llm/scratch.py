"""Intermediate tables in the folder that all executors share, and what executors are sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewise.sources.store import broadcast, new_path

#: Rows per Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 256


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage; it goes when the driver ends."""
    path = new_path(spark, name)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` once and reads it back: lineage ends here and a lost executor costs no recomputation."""
    path = folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers(spark: SparkSession) -> None:
    """Sends this package to the executors and keeps Arrow batches small."""
    broadcast(spark, None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
