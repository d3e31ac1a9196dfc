"""Cutting lineage through the shared folder of the cluster, and removing what was written for a while only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# A missing path is an analysis error, a damaged file a failure inside the JVM.
UNREADABLE = (PySparkException, Py4JJavaError)

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folder: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="venuematch-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the open :func:`scratch_folder`, or else in the shared folder."""
    return f"{_folder.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """Tables stored inside the ``with`` block go to one folder, which is removed at its end.

    Results that read them are lazy, so they have to be written or collected inside the block.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
        remove(spark, path)


@contextmanager
def stored_under(path: str) -> Iterator[str]:
    """Tables stored inside the ``with`` block go to a folder that the caller removes."""
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none when there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in fs.listStatus(folder)] if fs.exists(folder) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, and its folders; one that is there already is an error."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(file.getParent())
    if not fs.createNewFile(file):
        raise FileExistsError(path)


def materialize(df: DataFrame, label: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write once and read back, so later branches neither recompute nor depend on live executors.

    The shuffle files behind the table are removed when it is written, instead of when the driver collects garbage.
    ``file_rows`` bounds the rows of a file: rows that take far more work and memory than bytes on disk are so read by
    tasks of as many rows, and not by size alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def modified_at(spark: SparkSession, path: str) -> int | None:
    """Commit time of a finished output folder in milliseconds, or null when there is none."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(marker).getModificationTime() if fs.exists(marker) else None
