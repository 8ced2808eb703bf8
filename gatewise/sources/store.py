"""Shared storage: where lineage is cut, where fitted tables live, what executors are sent."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Driver-side folders of the archives sent, by application; executors fetch from the driver.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; one is made here only where it is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gatewise-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, name: str = "rows") -> DataFrame:
    """Writes ``df`` once to shared storage and reads it back without its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in shared storage, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _file_system(spark: SparkSession, path: str):
    """A path of Hadoop's, and the file system it lies in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    where, files = _file_system(spark, path)
    part = where.suffix(".part")
    out = files.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not files.rename(part, where):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    where, files = _file_system(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder, in the order of their names."""
    where, files = _file_system(spark, f"{folder}/{pattern}")
    return sorted(str(f.getPath().toString()) for f in files.globStatus(where) or ())


def remove(spark: SparkSession, folder: str) -> None:
    """Removes what an earlier run has written to its own folder."""
    where, files = _file_system(spark, folder)
    files.delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once; needed before any job whose tasks run its Python code."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        home, name = os.path.split(package)
        folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="gatewise-")
        context.addPyFile(shutil.make_archive(os.path.join(folder.name, name), "zip", home, name))


def broadcast(spark: SparkSession, value) -> Broadcast:
    """Broadcasts ``value``, once this package has been sent to the executors."""
    ship(spark)
    return spark.sparkContext.broadcast(value)
