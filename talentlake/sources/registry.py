"""The registry of sources: later loads override earlier ones by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.sources.files import as_json, detect_format

_FIELDS = "enabled: boolean, priority: int, source_type: string, legal_mode: string, rate_limit_rps: double, ats_type: string, options: map<string,string>"
#: What a source has that doesn't say otherwise.
DEFAULTS = {"enabled": True, "priority": 100, "source_type": "ats", "legal_mode": "api", "rate_limit_rps": 2.0}


def defined(rows: DataFrame) -> DataFrame:
    """Source definitions of a table with a name and any of the fields; missing and null fields take their defaults.  Rows without a name don't count."""
    out = {}
    for field in _FIELDS.split(", "):
        name, kind = field.split(": ")
        given = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        default = F.lit(DEFAULTS[name]) if name in DEFAULTS else F.create_map().cast(kind) if name == "options" else None
        out[name] = given if default is None else F.coalesce(given, default)
    return rows.where("name IS NOT NULL").select("name", *[c.alias(k) for k, c in out.items()])


def defined_in(text: DataFrame, kind: str = "json") -> DataFrame:
    """Source definitions in whole files (value), JSON or YAML: a map of name to fields, or a list of objects with a name.  Another shape is an error."""
    if kind == "yaml":
        text = text.select(as_json(F.col("value")).alias("value"))
    text = text.where("value IS NOT NULL")
    head = F.substring(F.trim("value"), 1, 1)
    listed = F.from_json("value", f"array<struct<name: string, {_FIELDS}>>")
    named = F.transform(F.map_entries(F.from_json("value", f"map<string, struct<{_FIELDS}>>")), lambda e: F.struct(e["key"].alias("name"), *[e["value"][f.split(":")[0]].alias(f.split(":")[0]) for f in _FIELDS.split(", ")]))
    found = F.when(head == "[", listed).when(head == "{", named).otherwise(F.raise_error(F.lit("a source file holds a map or a list")))
    return defined(text.select(F.inline(found)))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source definitions of a JSON or YAML file; a missing one is an error."""
    return defined_in(spark.read.option("wholetext", True).text(path), detect_format(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Source definitions stored as Parquet."""
    return defined(spark.read.parquet(path))


def overlaid(*loads: DataFrame) -> DataFrame:
    """All sources by name; of several loads the last one that has a name counts."""
    numbered = [load.withColumn("__load", F.lit(k)) for k, load in enumerate(loads)]
    both = numbered[0]
    for more in numbered[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("name", "__load")]
    last = both.groupBy("name").agg(F.max_by(F.struct(*rest), "__load").alias("r"))
    return last.select("name", "r.*")


def ordered(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("priority", "name")


def stats(sources: DataFrame) -> DataFrame:
    """Sources by type and legal mode, and how many are enabled."""
    return sources.groupBy("source_type", "legal_mode").agg(F.count("*").alias("n"), F.count_if("enabled").alias("enabled"))


def scraped(sources: DataFrame) -> DataFrame:
    return sources.where("legal_mode = 'scrape'").select("name")
