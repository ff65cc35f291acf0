"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="talentlake-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder, with their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether the shuffle files of an execution go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_left: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: as ``cut``, but with its true size, where estimates would multiply in an iteration.

    The shuffle files that made it go at once, so that the disk holds those of one table at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    _left.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes the tables that ``written`` has left so far, once all results that rest on them are stored elsewhere; gives their number."""
    conf, fs = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    paths = _left[:]
    for path in paths:
        p = fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _left.remove(path)
    return len(paths)


def release() -> None:
    """Gives what a task has freed back to the machine, as the worker's process lives on beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
