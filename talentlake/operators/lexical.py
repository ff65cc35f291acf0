"""Lexical search over stored postings, scored by BM25.

Postings are lists by token, of the keys that hold it with their counts and lengths, in folders by the hash of the token, sorted by token within
their files, so that a query opens the folders of its own tokens and skips the row groups of others.  Lists are gathered a batch of
rows at a time, so one token may have many lists, and none grows with the table.  Document frequencies lie in folders of the same kind.
Rows are added as a segment of their own, without reading what is there; counts are summed when a query runs.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions.text import query_tokens

_WORD = re.compile("[a-z0-9]+")
#: The usual constants of BM25.
K1, B = 1.2, 0.75


class Postings:
    """Postings below ``path``, in ``buckets`` folders; keys, of the type ``kind``, are unique over all that is added."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 256, kind: str = "bigint"):
        self.spark, self.path, self.key, self.buckets, self.kind = spark, path.rstrip("/"), key, buckets, kind

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, columns: Sequence[str], spread: int = 8, batch: int = 1024) -> None:
        """Adds rows: their lower-case words of letters and digits, in all ``columns`` together.  Null columns are empty; a null key is left out."""
        texts = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), F.concat_ws(" ", *columns).alias("text"))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, batch):
                    part = whole.slice(at, batch)
                    ids: dict[str, int] = {}
                    token, row, tf, lengths = [], [], [], np.zeros(part.num_rows, np.int32)
                    for i, text in enumerate(part.column(1).to_pylist()):
                        words = _WORD.findall(text.lower())
                        lengths[i] = len(words)
                        counts = Counter(words)
                        token += [ids.setdefault(w, len(ids)) for w in counts]
                        tf += counts.values()
                        row += [i] * len(counts)
                    order = np.argsort(np.array(token, np.int64), kind="stable")
                    row_, starts = np.array(row, np.int64)[order], np.concatenate([[0], np.cumsum(np.bincount(np.array(token, np.int64), minlength=len(ids)))])
                    starts = pa.array(starts, pa.int32())
                    lists = [part.column(0).take(pa.array(row_)), pa.array(np.array(tf, np.int32)[order]), pa.array(lengths[row_])]
                    yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), *(pa.ListArray.from_arrays(starts, x) for x in lists)], ["token", "keys", "tfs", "lengths"])

        kind = texts.schema["key"].dataType.simpleString()
        found = texts.mapInArrow(gather, f"token string, keys array<{kind}>, tfs array<int>, lengths array<int>").withColumn("bucket", self._bucket(F.col("token")))
        # a token that very many rows hold is written by several tasks
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("keys"), F.lit(spread))).sortWithinPartitions("bucket", "token")
        segment = uuid.uuid4().hex
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        stored = self.spark.read.schema(f"token string, keys array<{kind}>, tfs array<int>, lengths array<int>, bucket int").parquet(f"{self.path}/postings/segment={segment}")
        stored.groupBy("bucket", "token").agg(F.sum(F.size("keys")).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.path}/frequencies/segment={segment}")
        words = texts.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).cast("long").alias("n"))
        words.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def _read(self, table: str) -> DataFrame:
        columns = f"keys array<{self.kind}>, tfs array<int>, lengths array<int>" if table == "postings" else "df long"
        return self.spark.read.schema(f"token string, {columns}, segment string, bucket int").parquet(f"{self.path}/{table}")

    def of(self, tokens: Sequence[str], table: str) -> DataFrame:
        """The stored rows of some tokens: only their folders are read."""
        buckets = self.spark.createDataFrame([(t,) for t in tokens], "t string").select(self._bucket(F.col("t")).alias("b")).distinct()
        return self._read(table).where(F.col("bucket").isin([r["b"] for r in buckets.collect()]) & F.col("token").isin(list(tokens)))

    def search(self, text: str, limit: int | None = 10, among: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(key, score), best first, ties by key; ``among`` (key) restricts the hits.  A text without content tokens finds nothing."""
        tokens = query_tokens(text)
        size = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        n, mean = size["n"], size["total"] / size["n"] if size["n"] and size["total"] else 1.0
        df = {r["token"]: r["df"] for r in self.of(tokens, "frequencies").groupBy("token").agg(F.sum("df").alias("df")).collect()} if tokens else {}  # the query's tokens
        if not df:
            return self.spark.createDataFrame([], f"{self.key} {self.kind}, score double")
        weight = F.create_map(*[x for t, f in sorted(df.items()) for x in (F.lit(t), F.log1p(F.lit((n - f + 0.5) / (f + 0.5))))])
        lists = self.of(sorted(df), "postings").select("token", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))).alias("p"))
        found = lists.select("token", "p.*")
        tf = F.col("tf").cast("double")
        part = weight[F.col("token")] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
        hits = found.select(F.col("key").alias(self.key), part.alias("part")).groupBy(self.key).agg(F.sum("part").alias("score"))
        if among is not None:
            hits = hits.join(among.select(self.key), self.key, "left_semi")
        hits = hits.orderBy(F.desc("score"), self.key)
        return hits if limit is None else hits.limit(limit)
