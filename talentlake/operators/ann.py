"""Approximate vector search over an inverted file, with an exact way beside it.

Centroids are fitted on a bounded sample; every row with a vector is stored in the folder of its nearest centroid's list, so that a query
reads a few folders only, and a condition on other columns reaches the scan before any vector is compared.  How many lists a
query needs is measured when the index is built: a sample of rows is searched exactly, and the least number of lists that finds
the asked share of their true neighbours is stored with the index.  A search whose condition leaves too few hits goes on to further lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions.vectors import cosine_to
from talentlake.operators.blocks import best_in_cells, best_of_each, cosine_score, merged


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fit(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of a sample, by spherical k-means from its first rows; an empty list takes the row that lies furthest off."""
    x = _unit(np.asarray(sample, np.float64))
    c = x[:lists].copy()
    for _ in range(rounds):
        near = x @ c.T
        own, score = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(score, kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def _good(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be compared: not empty, of finite components that aren't all zero."""
    x = F.col(vector)
    return rows.where((F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0))


class Index:
    """An inverted file below ``path``: rows in list=<n> folders, centroids and the number of lists to probe."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in about])
        self.probes, self.key, self.vector = about[0]["probes"], about[0]["key"], about[0]["vector"]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest(self, query: Sequence[float]) -> list[int]:
        """All lists, the nearest first."""
        return np.argsort(-(self.centroids @ np.asarray(query, np.float64)), kind="stable").tolist()

    def hits(self, query: Sequence[float], lists: list[int], where: Column | None = None) -> DataFrame:
        """(key, score) of the rows of some lists; only their folders are read."""
        rows = self.rows().where(F.col("list").isin(lists))
        if where is not None:
            rows = rows.where(where)
        return rows.select(self.key, cosine_to(query, F.col(self.vector)).alias("score"))

    def search(self, query: Sequence[float], limit: int = 10, skip: int = 0, threshold: float = 0.0, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(key, score), best first, ties by key.  ``exact`` reads all lists; otherwise lists are added, twice as many each time, until there are enough hits."""
        if not any(query):
            return self.rows().select(self.key, F.lit(0.0).alias("score")).limit(0)
        order = self.nearest(query)
        n = len(order) if exact else min(len(order), probes or self.probes)
        while True:
            found = self.hits(query, order[:n], where)
            if threshold > 0:
                found = found.where(F.col("score") >= threshold)
            if n == len(order) or where is None and threshold <= 0 or found.limit(skip + limit).count() == skip + limit:
                return found.orderBy(F.desc("score"), self.key).offset(skip).limit(limit)
            n = min(len(order), 2 * n)

    def search_each(self, queries: DataFrame, limit: int = 10, probes: int | None = None, block: int = 2048) -> DataFrame:
        """(q, place, id, score) for queries (id long, f array<double>): each meets the rows of its lists only, in blocks."""
        n, centroids = min(len(self.centroids), probes or self.probes), self.centroids
        sizes = self.rows().groupBy("list").agg(F.count("*").alias("n")).collect()  # a row a list
        parts = np.ones(len(centroids), np.int64)
        for r in sizes:
            parts[r["list"]] = -(-r["n"] // 100_000)  # lists of many rows in several parts

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, centroids.shape[1])
                lists = np.argsort(-(f @ centroids.T), axis=1, kind="stable")[:, :n]
                row, to = np.repeat(np.arange(len(f)), n), lists.ravel()
                row, to, many = np.repeat(row, parts[to]), np.repeat(to, parts[to]), parts[to]
                part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(part), b.column(0).take(at), b.column(1).take(at)], ["list", "part", "id", "f"])

        q = queries.select(F.col("id").cast("long").alias("id"), F.col("f").cast("array<double>").alias("f")).mapInArrow(deal, "list long, part long, id long, f array<double>")
        q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))
        blocks = q.select("list", "block").distinct()  # the blocks that a list meets: lists times blocks at most
        many = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("list") + 1)
        rows = self.rows().select(F.col("list").cast("long").alias("list"), F.pmod(F.xxhash64(self.key), many).cast("long").alias("part"), F.col(self.key).cast("long").alias("id"), F.col(self.vector).cast("array<double>").alias("f"))
        c = rows.join(blocks, "list").withColumn("corpus", F.lit(True))
        dealt = q.withColumn("corpus", F.lit(False)).unionByName(c)
        return merged(best_in_cells(dealt, limit, cosine_score, ["list", "part", "block"]), limit)


def probes_needed(rows: DataFrame, key: str, vector: str, centroids: np.ndarray, sample: list, k: int, recall: float) -> int:
    """The least number of lists that holds the share ``recall`` of the true k neighbours of some rows, found by an exact search."""
    f = F.col(vector).cast("array<double>")
    spark = rows.sparkSession
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(sample)], "id long, f array<double>")
    corpus = rows.select(F.col(key).cast("long").alias("id"), f.alias("f"))
    true = best_of_each(queries, corpus, k).select("q", "id")
    where = {(r["q"], r["list"]): r["n"] for r in true.join(rows.select(F.col(key).cast("long").alias("id"), "list"), "id").groupBy("q", "list").agg(F.count("*").alias("n")).collect()}  # k rows a query at most
    order = np.argsort(-(np.asarray(sample, np.float64) @ centroids.T), axis=1, kind="stable")
    at = np.zeros(len(centroids))
    for (q, n), count in where.items():
        at[int(np.flatnonzero(order[q] == n)[0])] += count
    found = np.cumsum(at) / max(1, at.sum())
    return int(np.searchsorted(found, recall - 1e-12) + 1)


def build(rows: DataFrame, key: str, vector: str, path: str, lists: int = 64, sample: int = 20_000, calibration: int = 200, k: int = 10, recall: float = 0.95) -> Index:
    """Writes an index of all rows with a vector; centroids are fitted on ``sample`` rows, the number of lists to probe on ``calibration`` of them.

    ``key`` is a whole number, unique; vectors have one length.  All other columns are stored beside it, for conditions.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    good = _good(rows, vector).where(F.col(key).isNotNull())
    drawn = [list(map(float, r[0])) for r in good.select(F.col(vector), F.col(key)).orderBy(F.xxhash64(key), key).limit(sample).collect()]
    if not drawn:
        raise ValueError("no row has a vector")
    centroids = fit(np.array(drawn), min(lists, len(drawn)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, centroids.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(f @ centroids.T, axis=1).astype(np.int32))], [*names, "list"])

    names = [c for c in good.columns if c != "list"]
    at = names.index(vector)
    kept = good.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    settled = kept.mapInArrow(assign, f"{schema}, list int")
    # a list's rows go to a few tasks, whatever its size
    settled.repartition("list", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/rows")
    probes = probes_needed(spark.read.parquet(f"{path}/rows"), key, vector, centroids, drawn[:calibration], k, recall)
    about = [(i, c.tolist(), probes, key, vector) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "list int, centroid array<double>, probes int, key string, vector string").coalesce(1).write.parquet(f"{path}/about")
    return Index(spark, path)
