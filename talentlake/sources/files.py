"""Company files and seed tables as DataFrames with row_no in file order."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def detect_format(path: str) -> str:
    return {".csv": "csv", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}.get(PurePosixPath(path).suffix.lower(), "unknown")


def _numbered(rows: DataFrame) -> DataFrame:
    """row_no in file order: one file's splits are numbered in order of their offset."""
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns are text.  A byte order mark and fields beyond the header are ignored."""
    rows = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    clean = [c.lstrip("﻿") for c in rows.columns]
    return _numbered(rows.toDF(*clean))


def _from_tree(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows from a list of objects, a map of slug to object, or an object with a list of companies, as JSON text ``value``."""
    listed = F.from_json("value", "array<map<string,string>>")
    inside = F.from_json(F.get_json_object("value", "$.companies"), "array<map<string,string>>")
    by_slug = F.transform(F.map_entries(F.from_json("value", "map<string,map<string,string>>")), lambda e: F.map_concat(F.map_filter(e["value"], lambda k, _: k != "slug"), F.create_map(F.lit("slug"), F.coalesce(e["value"]["slug"], e["key"]))))
    is_list = F.substring(F.trim("value"), 1, 1) == "["
    found = F.when(is_list, listed).when(F.get_json_object("value", "$.companies").isNotNull(), inside).otherwise(by_slug)
    return rows.select(F.posexplode(found).alias("row_no", "fields"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, fields: map of text) of a JSON file in any of the three shapes."""
    return _from_tree(spark, spark.read.option("wholetext", True).text(path))


def as_json(text: Column) -> Column:
    """YAML texts as JSON, in the tasks that read them; null for an empty document."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import yaml

        return texts.map(lambda t: None if (x := yaml.safe_load(t)) is None else json.dumps(x, default=str))

    return convert(text)


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """(value): JSON or YAML files as JSON texts, one row a file, read by Spark from wherever they lie."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(as_json(F.col("value")).alias("value")) if detect_format(path) == "yaml" else text


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """As read_json, for YAML."""
    return _from_tree(spark, whole_json(spark, path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """As read_yaml, for company metadata: a list of objects or an object with such a list; none for all else and for a missing file."""
    try:
        text = whole_json(spark, path)
    except AnalysisException:  # no such file
        return spark.createDataFrame([], "row_no int, fields map<string,string>")
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.companies"), "array<string>"))
    objects = F.transform(F.filter(listed, lambda x: F.substring(F.trim(x), 1, 1) == "{"), lambda x: F.from_json(x, "map<string,string>"))
    return text.select(F.posexplode(objects).alias("row_no", "fields"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, checksum): the SHA-256 of each file that isn't empty, computed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("checksum"))


def collected(results: dict[str, DataFrame]) -> DataFrame:
    """The raw postings of all collectors in one table, with the collector's name; columns that one lacks are null."""
    first, *rest = [rows.withColumn("collector", F.lit(name)) for name, rows in results.items()]
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first


def archive(rows: DataFrame, path: str, now: Column) -> None:
    """Appends raw postings (collector, raw) to the archive, by collector and day, with the digest of each."""
    stamped = rows.withColumns({"archived_at": now, "day": F.to_date(now), "digest": F.sha2("raw", 256)})
    stamped.write.mode("append").partitionBy("collector", "day").parquet(path)


def columns_of(fields: DataFrame, names: list[str]) -> DataFrame:
    """row_no and a text column for each name, from (row_no, fields)."""
    return fields.select(F.col("row_no").cast("long"), *[F.col("fields")[n].alias(n) for n in names])


def read_companies(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    kind = detect_format(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return columns_of(read_json(spark, path), names)
    if kind == "yaml":
        return columns_of(read_yaml(spark, path), names)
    raise ValueError(f"unsupported file {path!r}")


def seed_entries(lines: DataFrame) -> DataFrame:
    """(seq, name, career_url) from the lines (seq, value) of a Markdown table; of equal names the first counts."""
    line = F.trim("value")
    low = F.lower(line)
    skip = line.rlike(r"^[-+=| ]*$") | low.startswith("company") | low.startswith("> ") | low.startswith("#") | (low == "careers")
    url = F.regexp_extract("value", r"(https?://\S+)", 1)
    before = F.trim(F.replace(F.regexp_extract("value", r"^(.*?)https?://", 1), F.lit("|"), F.lit(" ")))
    name = F.trim(F.regexp_replace(before, r"\s{2,}.*$", ""))
    rows = lines.where(~skip & (url != "")).select("seq", name.alias("name"), F.regexp_replace(url, r"[.,;]+$", "").alias("career_url")).where("name <> ''")
    first = rows.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("seq", "name", "career_url"), "seq").alias("r"))
    return first.select("r.*")


def read_seed_table(spark: SparkSession, path: str) -> DataFrame:
    return seed_entries(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))


#: Raw postings as they come in with a request.
INLINE = T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("external_id", "title", "company", "url", "location", "description", "posted")]])


def inline_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Raw postings from a request; ``posted`` becomes part of the payload."""
    rows = spark.createDataFrame([tuple(x.get(f) if f != "seq" else k for f in INLINE.fieldNames()) for k, x in enumerate(items)], INLINE)
    return rows.withColumn("raw", F.to_json(F.struct("posted"))).drop("posted")
