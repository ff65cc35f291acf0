"""Aggregates over ranked jobs and runs.  Ties go to what appeared first (least ``seq``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.functions.text import filled
from talentlake.operators.selection import medians
from talentlake.operators.shared import cut, written


def place_name() -> Column:
    """City, else country, else Remote, else Unknown."""
    return F.coalesce(filled(F.col("location.city"), F.col("location.country")), F.when(F.col("location.is_remote"), F.lit("Remote")), F.lit("Unknown"))


def top_counts(rows: DataFrame, key: Column, n: int, explode: bool = False) -> DataFrame:
    """(key, n): the most frequent values of ``key``, or of its elements."""
    # of an inner explode Spark infers a filter on the array's size, which goes below the projections and repeats them within itself
    values = rows.select("seq", (F.explode_outer(key) if explode else key).alias("key")).where("key IS NOT NULL")
    return values.groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first", "key").limit(n).select("key", "n")


def average_match(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.coalesce(F.avg("match.score"), F.lit(0.0)), 2).alias("average_match"))


def salary_stats(rows: DataFrame) -> DataFrame:
    """Count, min, max, mean and exact median of mid-range pay, by currency and period, most frequent first."""
    low = F.col("salary.min_amount")
    amount = (low + F.coalesce(F.nullif(F.col("salary.max_amount"), F.lit(0.0)), low)) / 2
    paid = cut(rows.where(low.isNotNull()).select("seq", F.coalesce(filled(F.col("salary.currency")), F.lit("?")).alias("currency"), F.coalesce(filled(F.col("salary.period")), F.lit("year")).alias("period"), amount.alias("amount")))
    stats = paid.groupBy("currency", "period").agg(
        F.count("*").alias("count"), F.min("amount").alias("min"), F.max("amount").alias("max"), F.round(F.avg("amount"), 2).alias("avg"), F.min("seq").alias("first")
    )
    stats = stats.join(medians(paid, ["currency", "period"], "amount"), ["currency", "period"], "left")
    return stats.orderBy(F.desc("count"), "first").select("currency", "period", "count", "min", "max", "avg", F.round("median", 2).alias("median"))


def hiring_trend(rows: DataFrame) -> DataFrame:
    """(day, n) of postings with a date, in order of day."""
    return rows.where("posted_date IS NOT NULL").groupBy(F.to_date("posted_date").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


#: The buckets of match scores.
BUCKETS = (("90-100", 90), ("75-89", 75), ("50-74", 50), ("0-49", 0))


def score_bucket(score: Column) -> Column:
    case = F.when(score >= BUCKETS[0][1], BUCKETS[0][0])
    for name, least in BUCKETS[1:-1]:
        case = case.when(score >= least, name)
    return case.otherwise(BUCKETS[-1][0])


def match_trend(rows: DataFrame) -> DataFrame:
    """Per resume: jobs, mean and best score, and a histogram without empty buckets."""
    scored = rows.where("match IS NOT NULL").select(F.col("match.resume_id").alias("resume_id"), F.col("match.score").alias("score"))
    counts = [F.count_if(score_bucket(F.col("score")) == name) for name, _ in BUCKETS]
    histogram = F.map_filter(F.create_map(*[x for (name, _), c in zip(BUCKETS, counts, strict=True) for x in (F.lit(name), c)]), lambda _, v: v > 0)
    return scored.groupBy("resume_id").agg(F.count("*").alias("jobs"), F.round(F.avg("score"), 2).alias("average"), F.max("score").alias("best"), histogram.alias("histogram"))


def new_today(rows: DataFrame, now: Column) -> DataFrame:
    return rows.agg(F.count_if(F.to_date("posted_date") == F.to_date(now)).alias("new_today"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(content_fingerprint, count, first): the groups of jobs that share a fingerprint, and the first job of each."""
    groups = rows.where("content_fingerprint <> ''").groupBy("content_fingerprint").agg(F.count("*").alias("count"), F.min("seq").alias("first"))
    return groups.where("count > 1")


def duplicate_members(rows: DataFrame) -> DataFrame:
    """(content_fingerprint, count, first, seq, label): one row for each job of such a group, so that no group has to fit one value."""
    label = F.concat_ws(" @ ", F.coalesce("normalized_role", "role"), "company_name")
    # written, as both sides of the join would make all rows anew
    rows = written(rows.where("content_fingerprint <> ''").select("content_fingerprint", "seq", label.alias("label")))
    return rows.join(duplicate_groups(rows), "content_fingerprint").select("content_fingerprint", "count", "first", "seq", "label")


def missing_skills(rows: DataFrame, n: int = 20) -> DataFrame:
    return top_counts(rows, F.col("match.missing_skills"), n, explode=True)


def bars(counts: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` counts with their share of the peak in per cent."""
    top = counts.orderBy(F.desc("n"), "key").limit(n)
    return top.withColumn("pct", F.round(F.col("n") * 100 / F.max("n").over(W.partitionBy()), 1))


def pipeline_performance(runs: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Totals over the latest runs, and the mean duration of each stage."""
    last = runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
    totals = last.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("collected", "stored", "duplicates", "filtered_out")], F.round(F.avg("duration_seconds"), 3).alias("avg_duration"))
    stages = last.select(F.explode("stages").alias("s")).groupBy(F.col("s.name").alias("stage")).agg(F.round(F.avg("s.duration_ms"), 2).alias("avg_ms"))
    return totals, stages


def run_totals(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs, ranked jobs, runs and the latest run, in one row."""
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("match").isNotNull()).alias("ranked"))
    r = runs.agg(F.count("*").alias("runs"), F.max_by("run_id", "started_at").alias("last_run"))
    return j.join(F.broadcast(r))  # one row each


def collector_rates(facts: DataFrame) -> DataFrame:
    """Counters and rates by collector from run facts: collector, jobs_found, duplicates, errors, response_ms."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    sums = facts.groupBy("collector").agg(
        F.count("*").alias("runs"), F.sum("jobs_found").alias("jobs"), F.sum("duplicates").alias("duplicates"), F.count_if(F.col("errors") > 0).alias("errors"),
        F.sum("response_ms").alias("response_total"), F.count("response_ms").alias("samples"), F.max("run_at").alias("last_run_at"),
    )
    return sums.select(
        "collector", "runs", "jobs", "duplicates", "errors", rate("response_total", "samples").alias("avg_response_ms"),
        F.coalesce(F.try_divide(F.col("runs") - F.col("errors"), F.col("runs")), F.lit(0.0)).alias("success_rate"),
        rate("errors", "runs").alias("error_rate"), rate("jobs", "runs").alias("jobs_per_run"), rate("duplicates", "jobs").alias("duplicate_rate"), "last_run_at",
    )


def collector_duplicates(rows: DataFrame) -> DataFrame:
    """Per collector: rows beyond the distinct external ids."""
    return rows.groupBy("collector").agg((F.count("*") - F.count_distinct("external_id")).alias("duplicates"))


COUNTERS = ("runs", "total_jobs_found", "total_duplicates", "total_errors", "total_response_ms", "response_samples")


def record_runs(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored counters by collector with the results of more runs added: COUNTERS and last_run_at; new collectors start from nothing.

    ``facts`` are (collector, jobs_found, duplicates, errors, response_ms, run_at); a null response time is no sample.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    more = facts.select(
        "collector", F.lit(1).cast("long").alias("runs"), number("jobs_found").alias("total_jobs_found"), number("duplicates").alias("total_duplicates"),
        number("errors").alias("total_errors"), F.coalesce("response_ms", F.lit(0)).cast("double").alias("total_response_ms"),
        F.when(F.col("response_ms").isNull(), 0).otherwise(1).cast("long").alias("response_samples"), F.col("run_at").alias("last_run_at"),
    )
    both = stored.select("collector", *COUNTERS, "last_run_at").unionByName(more)
    return both.groupBy("collector").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_run_at").alias("last_run_at"))
