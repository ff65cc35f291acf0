"""Greedy dedup against what earlier batches accepted, over a stored index of keys and prefix tokens.

A batch meets the index by joins: its keys in the folders that their hashes name, the prefix tokens of its sets with those of the accepted ones.  What
the index settles is a duplicate whatever the batch holds; the rest is deduplicated in itself, and what is accepted extends the index.  So
batches one after the other give what one run over all of them gives.

Prefix filtering needs one order of tokens for all sets; it is that of the frequencies in the first batch, stored once, with
later tokens as the rarest.  A batch is entered in the log when all its tables are written, so one that broke off leaves nothing
and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.operators.shared import cut, written
from talentlake.operators.similarity import classes
from talentlake.plans import dedup

_ROW = "seq long, job_hash string, url_key string, fingerprint string, canonical_key string, tokens array<string>, vector array<double>"
_TABLES = {"rows": _ROW, "keys": "kind string, key string, seq long", "prefixes": "id string, n int, at int, token string", "sets": "id string, tokens array<string>, n int"}


class Accepted:
    """The index of accepted postings below ``path``."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.9, buckets: int = 64):
        self.spark, self.path, self.threshold, self.buckets = spark, path.rstrip("/"), threshold, buckets

    def batches(self) -> list[tuple[int, int]]:
        """(batch, its largest seq) of all that are complete."""
        try:
            return [(r["batch"], r["last"]) for r in self.spark.read.schema("batch int, last long").parquet(f"{self.path}/log").orderBy("batch").collect()]
        except AnalysisException:  # nothing is stored yet
            return []

    def stored(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of all complete batches, of some folders only if they are named."""
        done = [n for n, _ in self.batches()]
        if not done:
            return self.spark.createDataFrame([], f"{_TABLES[name]}, batch int, bucket int")
        rows = self.spark.read.schema(f"{_TABLES[name]}, batch int, bucket int").parquet(f"{self.path}/{name}").where(F.col("batch").isin(done))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _save(self, name: str, rows: DataFrame, by: str, batch: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket(by)).repartition("bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("vector", "tokens")]), F.lit(4))).sortWithinPartitions("bucket", by)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")

    def _met(self, name: str, by: str, rows: DataFrame) -> DataFrame:
        """The stored rows in the folders that ``rows`` can meet."""
        wanted = [r[0] for r in rows.select(self._bucket(by)).distinct().collect()]  # so many folders at most
        return self.stored(name, wanted)

    def order(self, sets: DataFrame) -> DataFrame:
        """The frequencies by which tokens are ordered; those of ``sets`` in the first batch."""
        if not self.batches():
            dedup.frequencies(sets).write.mode("overwrite").parquet(f"{self.path}/order")
        return self.spark.read.schema("token string, df long").parquet(f"{self.path}/order")

    def deduplicate(self, jobs: DataFrame, crowd: int = 5_000, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
        """Verdicts of a batch, as ``dedup.deduplicate``, given all that was accepted before; what is accepted now is stored.

        ``seq`` must be unique and larger than those of earlier batches.  An empty batch gives no verdicts and is no batch.
        The vectors of a batch are compared with all stored ones.
        """
        rows = cut(dedup.records(jobs, encoder))
        low, high = rows.agg(F.min("seq"), F.max("seq")).first()
        done = self.batches()
        if done and low is not None and low <= max(last for _, last in done):
            raise ValueError("seq must be larger than in earlier batches")
        before = self.stored("rows").drop("batch", "bucket")
        sets = rows.where("fingerprint IS NOT NULL").groupBy(F.col("fingerprint").alias("id")).agg(F.min("tokens").alias("tokens"))
        order = self.order(sets)
        ordered = cut(dedup.ordered_sets(sets, order))
        prefix = written(dedup.prefixes(ordered, self.threshold))

        found, vectors = None, None
        if encoder is not None or "embedding" in jobs.columns:
            found, members = classes(rows.where("vector IS NOT NULL").select("seq", "vector").unionByName(before.select("seq", "vector")), "seq", "vector")
            vectors = found.select(F.col("cid").cast("string").alias("vec"), F.col("v").alias("vector"))
            rows, before = dedup.marked(rows, members), dedup.marked(before, members)
        else:
            rows, before = dedup.marked(rows, None), dedup.marked(before, None)
        rows = cut(rows)

        # what of the index the batch is like, by tokens and by vectors
        old = written(self._met("prefixes", "token", prefix).select("id", "n", "at", "token"))
        across = dedup.close_sets(prefix, ordered, old, self.stored("sets").select("id", "tokens"), self.threshold)
        similar = dedup.mark_pairs(None, written(across).where("a <> b"), self.threshold)
        if found is not None:
            similar = similar.unionByName(dedup.vectors_like(rows, before, found, self.threshold))
        similar = cut(similar)

        # the accepted rows that the batch touches: under a key, or under a mark that one of its own marks is like
        keys = dedup.key_rows(rows)
        stored_keys = self._met("keys", "key", keys.where("kind <> 'vec'")).select("kind", "key", F.col("seq").alias("least"))
        by_key = keys.join(stored_keys, ["kind", "key"]).select("least")
        if found is not None:
            by_key = by_key.unionByName(keys.where("kind = 'vec'").join(before.where("vec IS NOT NULL").select(F.col("vec").alias("key"), F.col("seq").alias("least")), "key").select("least"))
        named = similar.select("rel", F.col("other").alias("mark")).distinct()
        by_mark = dedup.mark_rows(before, 1).join(named, ["rel", "mark"]).select(F.col("seq").alias("least"))
        touched = cut(before.join(by_key.unionByName(by_mark).distinct().withColumnRenamed("least", "seq"), "seq", "left_semi"))

        rest = cut(rows.join(dedup.behind(rows, touched, similar), "seq", "left_anti"))
        own = None if found is None else written(found.join(rest.where("vec IS NOT NULL").select(F.col("vec").cast("long").alias("cid")).distinct(), "cid", "left_semi"))
        kept = cut(rows.join(dedup.accepted(rest, vectors, own, self.threshold, crowd), "seq", "left_semi"))
        similar = similar.unionByName(dedup.unexplained(rows, kept, found, self.threshold))
        verdicts = written(dedup.verdicts(rows, kept.unionByName(touched), similar))
        if low is not None:
            self._enter(rows.select("seq"), kept, jobs, ordered, prefix, dedup.records(jobs, encoder), len(done), high)
        return verdicts

    def _enter(self, every: DataFrame, kept: DataFrame, jobs: DataFrame, ordered: DataFrame, prefix: DataFrame, records: DataFrame, batch: int, last: int) -> None:
        own = kept.select("seq")
        self._save("rows", records.join(own, "seq", "left_semi").select("seq", "job_hash", "url_key", "fingerprint", "canonical_key", "tokens", "vector"), "seq", batch)
        self._save("keys", dedup.key_rows(kept).where("kind <> 'vec'").select("kind", "key", "seq"), "key", batch)
        ids = kept.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias("id"))
        self._save("prefixes", prefix.join(ids, "id", "left_semi").select("id", "n", "at", "token"), "token", batch)
        self._save("sets", ordered.join(ids, "id", "left_semi").select("id", "tokens", "n"), "id", batch)
        self.spark.createDataFrame([(batch, last)], "batch int, last long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
