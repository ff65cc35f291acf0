"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from talentlake.operators.shared import shuffles_go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talentlake-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder, with their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder: lineage ends there, and the planner knows its true size.

    A checkpoint would keep the estimates of its plan, which multiply with every join of an iteration.  The shuffle files that made
    the table go at once, so that the disk holds those of one table at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def slices(df: DataFrame, bytes_each: int, column: str = "text") -> int:
    """How many partitions hold about ``bytes_each`` bytes of ``column`` each; one small aggregate."""
    total = df.agg(F.sum(F.octet_length(column).cast("long") + 64)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // bytes_each))


_held: dict = {}


def held(key: tuple, make):
    """The object of ``key``, made once per Python worker; a worker holds one at a time, as it serves one operator at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives the memory that a task has freed back to the machine, as the worker's process lives on beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordHash(dict):
    """word (bytes) -> signed 64-bit hash, remembered; forgets everything when ``bound`` words are held."""

    def __init__(self, seed: int = 0, bound: int = 200_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def parts_of(batch: pa.RecordBatch, columns: list[int], rows: int, room: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``room`` bytes in ``columns``; one larger row is a part by itself."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        x = batch.column(c)
        if pa.types.is_string(x.type) or pa.types.is_binary(x.type):
            size += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(x.type):
            size += 16 * pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + room, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(df: DataFrame, inputs: list[str], ddl: str, make, rows: int = 256, room: int = 4_000_000) -> DataFrame:
    """``df`` with the columns of ``ddl``, computed in Arrow batches; like-named columns of ``df`` are replaced.

    ``make`` gets a list of Python values for each input and returns a list of values for each
    new column, of ``rows`` rows and about ``room`` bytes at a time.  All other columns pass through untouched, whatever their type.
    """
    added = T.StructType.fromDDL(ddl)
    kept = df.drop(*added.fieldNames())
    schema = T.StructType([*kept.schema.fields, *added.fields])
    # inputs that are about to be replaced travel beside the kept columns
    aside = {c: f"__in_{i}" for i, c in enumerate(inputs)}
    source = df.select(*[df[f"`{c}`"] for c in kept.columns], *[df[f"`{c}`"].alias(a) for c, a in aside.items()])
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.fieldNames()
    n = len(kept.columns)
    takes = list(range(n, n + len(inputs)))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_in:
            for part in parts_of(whole, takes, rows, room):
                made = make(*[part.column(j).to_pylist() for j in takes])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(n)), *arrays], names)
        release()

    return source.mapInArrow(run, schema)
