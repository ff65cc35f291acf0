"""Streams of postings: incremental intake, daily trends and collector states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.operators.shared import shared_dir


def first_seen(rows: DataFrame, key: str = "job_hash", at: str = "posted_date", late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, n) by tumbling windows of a day with a watermark."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(F.to_date("w.start").alias("day"), "n")


def run_available(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Drains what a stream has now, in update mode, and gives the latest row of each key.

    A batch writes only the rows that it changed, into a folder of its own number, so that a batch that is run again replaces itself and
    the watermark can free the state of old keys.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    write.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")).start().awaitTermination()
    return latest(spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows"), keys)


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change (by batch) of each key."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
