"""A stored table in buckets of its key, of which writes touch only those that hold changed keys.

Rows lie in folders by the hash of their key.  A change reads the folders of its keys, writes what they shall hold to the shared folder first, and then
overwrites just these folders.  A folder of which nothing is left keeps one row that marks it as empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.operators import store
from talentlake.operators.shared import written


class Buckets:
    """The table below ``path``; ``schema`` (DDL) names its columns, with created_at and updated_at among them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.schema = T.StructType.fromDDL(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField("__live", T.BooleanType()), T.StructField("bucket", T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.stored).parquet(self.path)
        except AnalysisException:  # nothing is stored yet
            return self.spark.createDataFrame([], self.stored)

    def rows(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders, which alone are read."""
        rows = self._all()
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(touched))
        return rows.where("__live").select(*self.schema.fieldNames())

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys."""
        return self.rows(self._touched(keys)).join(keys.select(*self.key), self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # so many folders at most

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        """Makes ``rows`` the content of the folders ``touched``."""
        if not touched:
            return
        live = rows.select(*self.schema.fieldNames()).withColumns({"__live": F.lit(True), "bucket": self._bucket()})
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("__live"), "bucket")
        # written first, as the folders that are read are the ones to be replaced
        made = written(live.unionByName(empty))
        made.repartition("bucket", F.pmod(F.xxhash64(*self.key), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, rows: DataFrame, now: Column) -> None:
        """As ``store.upsert``: rows replace stored ones of their key in all but created_at.  Keys must be unique."""
        rows = written(rows)
        touched = self._touched(rows)
        self._put(store.upsert(self.rows(touched), rows, self.key, now), touched)

    def insert_missing(self, rows: DataFrame, now: Column) -> None:
        """Adds the rows whose key isn't stored."""
        rows = written(rows)
        new = written(store.stamped(rows, now).join(self.get(rows).select(*self.key), self.key, "left_anti"))
        touched = self._touched(new)
        self._put(self.rows(touched).unionByName(new, allowMissingColumns=True), touched)

    def update(self, keys: DataFrame, changes: Mapping[str, Column], now: Column) -> None:
        """Changes columns of the stored rows of some keys."""
        keys = written(keys.select(*self.key).distinct().withColumn("__hit", F.lit(True)))
        touched = self._touched(keys)
        rows = self.rows(touched).join(keys, self.key, "left")
        self._put(store.update(rows, F.col("__hit"), {**changes, "updated_at": now}), touched)

    def delete(self, keys: DataFrame) -> None:
        """Removes the rows of some keys."""
        keys = written(keys.select(*self.key).distinct())
        touched = self._touched(keys)
        self._put(self.rows(touched).join(keys, self.key, "left_anti"), touched)
