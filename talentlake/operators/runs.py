"""Schedules, budgets, retries, states and statuses as row-wise rules."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.functions.parse import backoff_seconds
from talentlake.plans.normalize import SCHEMA_VERSION


def poll_interval(jobs_per_run: Column, error_rate: Column, runs: Column, rate_limit_rps: Column | None = None, base: float = 3600.0, least: float = 300.0, most: float = 86400.0) -> Column:
    """Seconds until the next poll: shorter the more jobs a run finds, longer the more runs fail, within bounds."""
    seconds = F.when(F.coalesce(runs, F.lit(0)) > 0, F.lit(base) * (1.0 / (1.0 + jobs_per_run / 10.0)) * (1.0 + error_rate * 4.0)).otherwise(F.lit(base))
    if rate_limit_rps is not None:
        seconds = F.when(rate_limit_rps > 0, F.greatest(seconds, 1.0 / rate_limit_rps)).otherwise(seconds)
    return F.round(F.greatest(F.lit(least), F.least(F.lit(most), seconds)), 2)


def is_due(now: Column) -> Column:
    """Whether a schedule (enabled, frequency, hour, weekday, day_of_month, last_run_at) is due; weekday 0 is Monday."""
    last, today = F.to_date("last_run_at"), F.to_date(now)
    daily = last.isNull() | (last < today)
    weekly = (F.weekday(now) == F.col("weekday")) & (last.isNull() | (F.datediff(today, last) >= 7))
    monthly = (F.dayofmonth(now) == F.col("day_of_month")) & (last.isNull() | (F.trunc(last, "month") != F.trunc(today, "month")))
    kind = F.col("frequency")
    due = F.when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "monthly", monthly).otherwise(False)
    return F.coalesce(F.col("enabled") & (F.hour(now) >= F.col("hour")) & due, F.lit(False))


def already_succeeded(runs: DataFrame, now: Column) -> DataFrame:
    """One row: has a run of this day succeeded."""
    return runs.agg(F.coalesce(F.bool_or((F.col("status") == "success") & (F.to_date("started_at") == F.to_date(now))), F.lit(False)).alias("already_ran"))


#: The default budgets.
BUDGETS = {"response_ms": 5000.0, "crawl_seconds": 120.0, "import_rps": 50.0}


def budget_violations(avg_response_ms: Column, crawl_seconds: Column, rows: Column | None = None, seconds: Column | None = None, budgets: dict[str, float] = BUDGETS) -> Column:
    """array of (metric, observed, threshold) for every budget that is exceeded."""
    found = lambda name, x, bad: F.when(bad, F.struct(F.lit(name).alias("metric"), x.cast("double").alias("observed"), F.lit(budgets[name]).alias("threshold")))
    checks = [found("response_ms", avg_response_ms, avg_response_ms > budgets["response_ms"]), found("crawl_seconds", crawl_seconds, crawl_seconds > budgets["crawl_seconds"])]
    if rows is not None and seconds is not None:
        rps = F.when((seconds > 0) & (rows > 0), rows / seconds)
        checks.append(found("import_rps", rps, rps < budgets["import_rps"]))
    return F.array_compact(F.array(*checks))


def run_status(jobs: Column, failures: Column, recipient: Column, production: Column, delivered: Column) -> Column:
    """success, partial or failed from what a run did."""
    soft = F.when(failures > 0, "partial").otherwise("success")
    no_one = F.coalesce(recipient, F.lit("")) == ""
    return F.when((jobs == 0) & (failures > 0), "failed").when(no_one & production, "failed").when(no_one, soft).when(delivered, soft).otherwise("failed")


def retry_tasks(failures: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Failed tasks with their next attempt: exhausted after ``max_attempts``."""
    state = F.when(F.col("attempts") >= max_attempts, "exhausted").otherwise("pending")
    wait = backoff_seconds(F.col("attempts"))
    at = F.timestamp_micros(F.unix_micros("failed_at") + (wait * 1_000_000).cast("long"))
    return failures.withColumns({"status": state, "backoff_seconds": wait, "next_attempt_at": at})


def due_retries(tasks: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    return tasks.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "task_id").limit(limit)


#: The states a collector may go to.
TRANSITIONS = {
    "idle": ("syncing", "disabled"),
    "syncing": ("idle", "rate_limited", "backoff", "failed", "disabled"),
    "rate_limited": ("syncing", "backoff", "idle", "disabled"),
    "backoff": ("syncing", "idle", "failed", "disabled"),
    "failed": ("syncing", "backoff", "idle", "disabled"),
    "disabled": ("idle",),
}


def transitions(events: DataFrame, initial: str = "idle") -> DataFrame:
    """Each event (event_id, collector, at, state) with the state before it and whether the step is legal.

    Events are put in order within a day of a collector; what a day begins with is the last state of the collector's day before it, from a
    table of one row a day.  So few busy collectors don't make few long tasks.
    """
    dated = events.withColumn("__day", F.to_date("at"))
    earlier = F.lag(F.struct("state")).over(W.partitionBy("collector", "__day").orderBy("at", "event_id"))
    ends = dated.groupBy("collector", "__day").agg(F.max_by(F.struct("state"), F.struct("at", "event_id")).alias("__last"))
    ends = ends.withColumn("__begin", F.lag("__last").over(W.partitionBy("collector").orderBy("__day"))).select(F.col("collector").alias("__of"), F.col("__day").alias("__on"), "__begin")
    same = dated["collector"].eqNullSafe(ends["__of"]) & dated["__day"].eqNullSafe(ends["__on"])
    dated = dated.withColumn("__earlier", earlier).join(ends, same, "left")
    before = F.coalesce(F.coalesce("__earlier", "__begin")["state"], F.lit(initial))
    legal = F.create_map(*[x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, to)))])
    ok = (F.col("state") == before) | F.array_contains(legal[before], F.col("state"))
    return dated.withColumns({"before": before, "legal": F.coalesce(ok, F.lit(False))}).drop("__day", "__earlier", "__begin", "__of", "__on")


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.unix_micros(F.col(at).cast("timestamp")) >= F.unix_micros(now) - days * 86_400_000_000)


def latest(rows: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; ties go to the largest ``tie``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def capable(offered: Column, wanted: Column) -> Column:
    """Does an offer hold all wanted capabilities."""
    return F.size(F.array_except(wanted, offered)) == 0


def version_numbers(version: Column) -> Column:
    """The numbers of a version, which compare as versions do: 1.10 comes after 1.9.  What is no number counts as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def version_at_least(version: Column, least: Column) -> Column:
    return version_numbers(version) >= version_numbers(least)


def run_ids(run_id: str | None = None, correlation_id: str | None = None) -> dict[str, str]:
    """The ids of one run: those given, or new ones."""
    return {"run_id": run_id or f"run_{uuid.uuid4().hex}", "correlation_id": correlation_id or f"cor_{uuid.uuid4().hex}"}


def with_run(rows: DataFrame, ids: dict[str, str]) -> DataFrame:
    """``rows`` with the ids of their run as columns."""
    return rows.withColumns({k: F.lit(v) for k, v in ids.items()})


#: Versions of the report layout and of this library.
REPORT_VERSION, PIPELINE_VERSION = 1, "2.0"


def versions(jobs: DataFrame) -> DataFrame:
    """One row: the versions of report, schema and pipeline, and those of the collectors that produced ``jobs``, by source (the latest of each)."""
    by_source = jobs.where("collector_version IS NOT NULL").groupBy("source").agg(F.max_by("collector_version", F.struct(version_numbers(F.col("collector_version")).alias("n"), "collector_version")).alias("v"))
    # one entry a source
    found = by_source.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "v")))).alias("collector_versions"), F.lit(0).alias("n"))
    return found.select(F.lit(REPORT_VERSION).alias("report_version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(PIPELINE_VERSION).alias("pipeline_version"), "collector_versions")
