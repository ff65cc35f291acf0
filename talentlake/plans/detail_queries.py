"""Queries that show the parts of results which other queries leave out, files as sources, and the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions import terms
from talentlake.operators import analytics
from talentlake.operators.buckets import Buckets
from talentlake.operators.exports import COLUMNS, job_rows
from talentlake.operators.rank import Resume, rank, scores
from talentlake.plans import daily, filters
from talentlake.plans import oracle as o
from talentlake.plans.job_queries import _ALIAS, _RANKED, _SCORE, MAX_HOURS, RESUME, aliases, jobs, now
from talentlake.plans.jobs_view import jobs_v, table
from talentlake.plans.match_queries import _COS, _folder
from talentlake.plans.other_queries import QUERY
from talentlake.plans.registry import query
from talentlake.plans.registry import sql_text as q
from talentlake.sources import records, registry

_TEXT = "concat_ws(' ', title, description)"
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"


@query(_RANKED.rstrip() + f", s AS (SELECT CAST({_SCORE} AS DOUBLE) AS score FROM parts) SELECT 'ai' AS resume_id, round(round(avg(score), 2), 1) AS average, round(max(score), 1) AS best FROM s")
def match_trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean and the best score, to one place."""
    trend = analytics.match_trend(scores(jobs(spark, sf_dir), RESUME, F.lit("2020-01-01 00:00:00").cast("timestamp")))
    return trend.select("resume_id", F.round("average", 1).alias("average"), F.round("best", 1).alias("best"))


_KNOWN = ", ".join(q(s.lower()) for s in RESUME.skills)


@query(
    f"{o.ORACLE_JOBS.rstrip()}, k AS (SELECT seq, {o.skills(_TEXT, o.ALL_SKILLS)} AS listed, {o.skills(_TEXT, terms.TECHNICAL)} AS technical FROM jobs_v), "
    f"m AS (SELECT *, list_filter(listed, lambda s: lower(s) NOT IN ({_KNOWN})) AS away, list_filter(listed, lambda s: lower(s) IN ({_KNOWN})) AS here FROM k), "
    "t AS (SELECT *, list_concat(list_filter(away, lambda s: list_contains(technical, s)), list_filter(away, lambda s: NOT list_contains(technical, s))) AS missing, list_concat(list_filter(here, lambda s: list_contains(technical, s)), list_filter(here, lambda s: NOT list_contains(technical, s))) AS matched FROM m) "
    "SELECT seq, array_to_string(matched, ';') AS matched, array_to_string(list_transform(missing, lambda s: concat(s, ':', CASE WHEN list_contains(technical, s) THEN 10 ELSE 6 END, ':', CAST(round(round(1 / len(listed) * CASE WHEN list_contains(technical, s) THEN 1.0 ELSE 0.6 END, 4) * 10000) AS BIGINT))), ';') AS learn FROM t"
)
def learning_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each job what is matched and what is to be learnt, technical skills first, with priority (tenths) and impact (ten-thousandths)."""
    gap = rank(jobs(spark, sf_dir), RESUME, now()).select("seq", "gap")
    told = F.transform("gap.learning_priority", lambda x: F.concat_ws(":", x["skill"], F.round(x["priority"] * 10).cast("long"), F.round(x["estimated_impact"] * 10000).cast("long")))
    return gap.select("seq", F.array_join("gap.matched", ";").alias("matched"), F.array_join(told, ";").alias("learn"))


@query(
    o.JOBS.rstrip()
    + f""", {o.salary("jobs")}, k AS (SELECT seq, {o.skills(_TEXT, o.ALL_SKILLS)} AS listed, {o.skills(_TEXT, terms.TECHNICAL)} AS technical FROM jobs_v)
SELECT p.seq, p.company, coalesce(a.canonical, '') AS canonical_company, title AS role, normalized_role, coalesce(city, country, CASE WHEN is_remote THEN 'Remote' END, '') AS location, work_mode, coalesce(country, '') AS country, employment_type,
  p.min_years AS experience_min_years, p.max_years AS experience_max_years, level AS seniority, min_amount AS salary_min, max_amount AS salary_max, coalesce(currency, '') AS currency, coalesce(strftime(posted_date, '%Y-%m-%d'), '') AS posted_date,
  NULL::DOUBLE AS match_score, NULL::DOUBLE AS similarity, NULL::DOUBLE AS skill_match, array_to_string(listed, '; ') AS skills, array_to_string(technical, '; ') AS technologies, 'inline' AS source, 'unknown' AS ats_type, url AS apply_url, '' AS career_url
FROM paid p JOIN k USING (seq) LEFT JOIN {_ALIAS} ON lower(trim(p.company)) = a.alias"""
)
def export_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of an export."""
    return job_rows(jobs(spark, sf_dir)).select("seq", *COLUMNS)


@query(
    f"""{o.ORACLE_JOBS.rstrip()}, e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
f AS (SELECT seq, {_COS("v", _Q)} AS similarity, CASE company WHEN 'Flipkart' THEN 0.9 WHEN 'Zomato' THEN 1.0 ELSE 0.5 END AS priority, (epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(posted_date)) / 3600 AS age FROM jobs_v JOIN e ON seq % (SELECT count(*) FROM embeddings) = vec_id)
SELECT seq, CAST(round(round(similarity, 4) * 1000) AS BIGINT) AS similarity, CAST(round(priority * 1000) AS BIGINT) AS priority, CAST(round(CASE WHEN age IS NULL THEN 0.5 WHEN age <= 24 THEN 1 ELSE greatest(0, 1 - age / 720) END * 1000) AS BIGINT) AS freshness FROM f"""
)
def rank_parts_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to a vector, company priority and freshness, in thousandths."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    rows = jobs(spark, sf_dir).withColumn("vec_id", F.col("seq") % n).join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id")
    known = spark.sql("SELECT * FROM VALUES ('Flipkart', 0.9D, 0), ('Zomato', 1.7D, 1) AS t(name, priority_score, ord)")
    ranked = rank(rows, Resume("ai", QUERY), F.lit("1998-08-02 00:00:00").cast("timestamp"), known)
    k = lambda c: F.round(F.col(f"match.{c}") * 1000).cast("long")
    return ranked.select("seq", k("similarity").alias("similarity"), k("company_priority").alias("priority"), k("freshness").alias("freshness"))


_NAME = "CASE c_custkey % 5 WHEN 0 THEN concat('Co, ', c_name) WHEN 1 THEN concat('say \"', c_name, '\"') WHEN 2 THEN concat(c_name, '{nl}second line, \"quoted\"') ELSE c_name END"


@query("SELECT c_custkey AS id, " + _NAME.replace("{nl}", "' || chr(10) || '") + " AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS row_no FROM customer")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies written as CSV files, with commas, quotes and line ends in their fields, and read by blocks with their row numbers."""
    rows = table(spark, sf_dir, "customer").withColumn("part", F.floor(F.col("c_custkey") / 1000))
    folder = _folder(spark, "csv")
    named = rows.select(F.col("c_custkey").alias("id"), F.expr(_NAME.replace("{nl}", "\\n")).alias("name"), F.col("c_mktsegment").alias("segment"), "part")
    named.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").option("header", True).option("escape", '"').csv(folder)
    return records.csv_rows(spark, folder).select(F.col("id").cast("long").alias("id"), "name", "segment", "row_no")


@query("SELECT concat('source_', n_nationkey) AS name, n_nationkey % 3 > 0 AS enabled, CASE WHEN n_nationkey % 4 = 0 THEN 100 ELSE n_nationkey END::INTEGER AS priority, 'ats' AS source_type, CASE WHEN n_nationkey % 2 = 0 THEN 'scrape' ELSE 'api' END AS legal_mode, 2.0::DOUBLE AS rate_limit_rps FROM nation")
def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources from a JSON file (a list), overlaid by those of a YAML file (a map); both are written from nations."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation")
    entry = F.struct(F.concat(F.lit("source_"), n.cast("string")).alias("name"), (n % 3 > 0).alias("enabled"), F.lit(7).alias("priority"), F.lit("feed").alias("legal_mode"))
    listed = rows.agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value"))  # one file, as it is read
    line = F.concat(F.lit("source_"), n.cast("string"), F.lit(": {enabled: "), (n % 3 > 0).cast("string"), F.when(n % 4 > 0, F.concat(F.lit(", priority: "), n.cast("string"))).otherwise(""), F.when(n % 2 == 0, F.lit(", legal_mode: scrape")).otherwise(""), F.lit("}"))
    mapped = rows.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    found = []
    for kind, text in (("json", listed), ("yaml", mapped)):
        folder = _folder(spark, "sources")
        text.coalesce(1).write.text(folder)
        part = spark.read.text(folder).select(F.input_file_name()).first()[0]
        found.append(registry.defined_in(spark.read.option("wholetext", True).text(part), kind))
    return registry.overlaid(*found).select("name", "enabled", "priority", "source_type", "legal_mode", "rate_limit_rps")


@query()
def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, n): the whole run, from raw postings to the stored table of ranked jobs.  Not SQL, as acceptance depends on acceptance."""
    from talentlake.functions.vectors import Hasher

    vector = [float(x) for x in Hasher().encode(["python pytorch rag machine learning engineer"])[0]]
    stored = Buckets(spark, _folder(spark, "jobs"), "job_hash string, seq long, role string, company_name string, url string, score double, created_at timestamp, updated_at timestamp", ["job_hash"], 32)
    done = daily.daily(jobs_v(spark, sf_dir), now(), Resume("ai", vector, RESUME.skills, RESUME.preferred_locations), filters.default_chain(now(), max_hours=MAX_HOURS), aliases(spark), table=stored)
    counts = spark.createDataFrame([*done.counts.items()], "stage string, n long")
    held = stored.rows().agg(F.lit("stored").alias("stage"), F.count("*").alias("n"))
    return done.rejected.select(F.concat(F.lit("rejected:"), "rejected_by").alias("stage"), "n").where("rejected_by <> 'passed'").unionByName(counts).unionByName(held)
