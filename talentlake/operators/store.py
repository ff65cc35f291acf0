"""Tables of records in Parquet: find, insert, upsert, update, delete.  Writers return the new state as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(rows: DataFrame, where: Column | str | None = None, sort: Sequence[Column | str] = (), skip: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, order, offset and limit; filters reach the scan."""
    if where is not None:
        rows = rows.where(where)
    if sort:
        rows = rows.orderBy(*sort)
    if skip:
        rows = rows.offset(skip)
    return rows if limit is None else rows.limit(limit)


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """created_at where it is null, and updated_at."""
    created = F.coalesce("created_at", now) if "created_at" in rows.columns else now
    return rows.withColumns({"created_at": created, "updated_at": now})


def insert(stored: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    return stored.unionByName(stamped(rows, now), allowMissingColumns=True)


def upsert(stored: DataFrame, rows: DataFrame, key: Sequence[str], now: Column) -> DataFrame:
    """Rows replace stored ones of the same key in every field but created_at; others stay.  Keys of ``rows`` must be unique."""
    old = stored.select(*key, F.col("created_at").alias("__created"))
    fresh = rows.drop("created_at", "updated_at").join(old, list(key), "left")
    fresh = fresh.withColumns({"created_at": F.coalesce("__created", now), "updated_at": now}).drop("__created")
    return stored.join(rows.select(*key), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_missing(stored: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds rows whose key isn't stored."""
    return stored.unionByName(rows.join(stored.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def update(stored: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return stored.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete(stored: DataFrame, where: Column) -> DataFrame:
    return stored.where(~F.coalesce(where, F.lit(False)))


def save_version(stored: DataFrame, row: DataFrame, key: Sequence[str], now: Column) -> DataFrame:
    """Upsert with version = stored version + 1."""
    old = stored.select(*key, F.col("version").alias("__version"))
    rows = row.drop("version").join(old, list(key), "left").withColumn("version", F.coalesce("__version", F.lit(0)) + 1).drop("__version")
    return upsert(stored, rows, key, now)


def put_element(array: Column, element: Column, key: str) -> Column:
    """An array of structs with the element of the same key replaced, at the end."""
    return F.concat(F.filter(array, lambda x: x[key] != element[key]), F.array(element))


def keep_last(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Both tables, rows of the overlay in place of those with their key."""
    return base.join(overlay.select(key), key, "left_anti").unionByName(overlay, allowMissingColumns=True)


def stale(rows: DataFrame, stored: DataFrame, key: str, model: str, version: int) -> DataFrame:
    """Rows without a fresh embedding: none stored, or of another content, model or version."""
    old = stored.select(key, F.col("content_hash").alias("__hash"), F.col("model_name").alias("__model"), F.col("embedding_version").alias("__version"))
    fresh = F.col("__hash").eqNullSafe(F.col("content_hash")) & F.col("__model").eqNullSafe(F.lit(model)) & F.col("__version").eqNullSafe(F.lit(version))
    return rows.join(old, key, "left").where(~fresh).drop("__hash", "__model", "__version")
