"""Intermediate tables that survive the loss of an executor.

An iterative job has to cut its lineage. A table written to the folder all
executors share does that, costs one computation of the frame, is columnar on the
way back, and is still there when an executor goes away.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
# Tables to delete, per thread with an open temporary_tables() block.
_written: dict[int, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="rollcall-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if threading.get_ident() in _written:
        _written[threading.get_ident()].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables materialized in the block when it ends.

    For a block that writes its result elsewhere, such as one micro-batch: a stream would
    otherwise fill the shared folder. Nothing but these tables is deleted.
    """
    thread = threading.get_ident()
    outer = _written.pop(thread, None)
    _written[thread] = []
    try:
        yield
    finally:
        written = _written.pop(thread)
        if outer is not None:
            _written[thread] = outer
        for path in written:
            location, files = _locate(spark, path)
            files.delete(location, True)


def _locate(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    location, files = _locate(spark, path)
    return files.exists(location)
