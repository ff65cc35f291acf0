"""Queries over vectors, companies, runs, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions import parse
from talentlake.functions.vectors import cosine
from talentlake.operators import analytics, companies, runs, search, store
from talentlake.operators.shared import shared_dir
from talentlake.plans.jobs_view import ORACLE_JOBS, jobs_v, table
from talentlake.plans.registry import query
from talentlake.plans.registry import sql_text as q
from talentlake.sources import ats, files, registry
from talentlake.streaming import stateful, trends

# --- vectors: the query vector is a fixed pattern of 64 numbers

QUERY = [((k * 37) % 11 - 5) / 10.0 for k in range(64)]
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_SCORED = f"SELECT vec_id, label, greatest(0, {_DOT('embedding', _Q)} / sqrt({_DOT('embedding', 'embedding')} * {_DOT(_Q, _Q)})) AS score FROM embeddings"


def _near(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    hits = search.vector_search(table(spark, sf_dir, "embeddings"), QUERY, "vec_id", **options)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, limit=10)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_SCORED}) WHERE score >= 0.2")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows over the threshold."""
    return _near(spark, sf_dir, limit=None, threshold=0.2)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10 OFFSET 20")
def vector_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, limit=10, skip=20)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_SCORED}) WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, limit=10, where=F.col("label").isin(1, 3))


_TEXT = "the erth of that reble with heing"
_TOKENS = ("erth", "that", "reble", "heing")  # what is left of it without stopwords


def _hybrid(tokens: tuple[str, ...]) -> str:
    leg = "CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s"
    return f"""WITH v AS (SELECT vec_id AS id, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 20),
w AS (SELECT doc_id AS id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), [{", ".join(map(q, tokens))}])) AS DOUBLE) AS score FROM documents),
t AS (SELECT * FROM w WHERE score > 0 ORDER BY score DESC, id LIMIT 20), vs AS (SELECT id, {leg} FROM v), ts AS (SELECT id, {leg} FROM t)
SELECT coalesce(vs.id, ts.id) AS id, round(0.6 * coalesce(vs.s, 0) + 0.4 * coalesce(ts.s, 0), 6) AS score FROM vs FULL JOIN ts ON vs.id = ts.id ORDER BY score DESC, id LIMIT 10"""


@query(_hybrid(_TOKENS))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leg reads its own table whole; only the best rows of both are joined."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = search.hybrid_search(vectors, QUERY, _TEXT, "id", ["text"], 10, texts=texts)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT v.vec_id, v.label, d.lang FROM (SELECT vec_id, label, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10) v LEFT JOIN documents d ON v.vec_id = d.doc_id")
def vector_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.vector_search(table(spark, sf_dir, "embeddings"), QUERY, "vec_id", 10)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id", "left")
    return search.hydrate(hits, rows, "vec_id").select("vec_id", "label", "lang")


@query(f"WITH a AS (SELECT vec_id, embedding FROM embeddings), b AS (SELECT vec_id AS other, embedding AS e FROM embeddings) SELECT vec_id, other, round(greatest(0, {_DOT('embedding', 'e')} / sqrt({_DOT('embedding', 'embedding')} * {_DOT('e', 'e')})), 6) AS score FROM a JOIN b ON vec_id + 1 = other")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of consecutive vectors, computed in the JVM."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return a.join(b, F.col("vec_id") + 1 == F.col("other")).select("vec_id", "other", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query(f"WITH b AS (SELECT vec_id AS other, embedding AS e FROM embeddings) SELECT vec_id, other, round(greatest(0, {_DOT('embedding', 'e')} / sqrt({_DOT('embedding', 'embedding')} * {_DOT('e', 'e')})), 6) AS score FROM embeddings JOIN b ON vec_id + 1 = other")
def cosine_neighbours_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of all consecutive vectors."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return a.join(b, F.col("vec_id") + 1 == F.col("other")).select("vec_id", "other", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


# --- companies: customers and suppliers stand for company records

_CATEGORY = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'automotive' WHEN 'BUILDING' THEN 'saas' WHEN 'FURNITURE' THEN 'nonsense' WHEN 'MACHINERY' THEN 'gcc' ELSE 'startup' END"
_COMPANY = f"""SELECT c_custkey AS row_no, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name, concat('co-', CAST(c_custkey % 1000 AS {{text}})) AS slug,
  CASE c_custkey % 7 WHEN 0 THEN concat('https://boards.greenhouse.io/co', CAST(c_custkey AS {{text}})) WHEN 1 THEN concat('https://co', CAST(c_custkey AS {{text}}), '.breezy.hr/jobs') WHEN 2 THEN 'not a url'
    WHEN 3 THEN concat('https://careers.co', CAST(c_custkey AS {{text}}), '.example/jobs') WHEN 4 THEN concat('https://co', CAST(c_custkey AS {{text}}), '.wd1.myworkdayjobs.com/x') WHEN 5 THEN NULL ELSE 'https://jobs.lever.co/' END AS career_url,
  CASE c_custkey % 5 WHEN 0 THEN 'Lever' WHEN 1 THEN 'bogus' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'greenhouse' END AS ats_type,
  CAST(NULL AS {{text}}) AS ats_token, CAST(NULL AS {{text}}) AS career_platform, {_CATEGORY} AS company_category, CASE c_nationkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'us' ELSE 'ZZ' END AS country FROM {{customer}}"""
_C = "WITH companies AS (" + _COMPANY.format(text="VARCHAR", customer="customer") + ")\n"


def company_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_COMPANY.replace("{text}", "STRING"), customer=table(spark, sf_dir, "customer"))


_CHECKED = (
    _C.rstrip()
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY row_no) AS ks, row_number() OVER (PARTITION BY career_url ORDER BY row_no) AS ku FROM companies),
checked AS (SELECT *, (name = '') AS no_name, coalesce(career_url = 'not a url', FALSE) AS bad_url, coalesce(lower(ats_type) = 'bogus', FALSE) AS bad_ats,
  company_category NOT IN ({", ".join(map(q, companies.COMPANY_CATEGORIES))}) AS bad_category, (upper(country) NOT IN ('IN', 'US')) AS bad_country, ks > 1 AS dup_slug, (career_url IS NOT NULL AND ku > 1) AS dup_url FROM n)
"""
)
_BAD = "(no_name OR bad_url OR bad_ats OR bad_country OR dup_slug OR dup_url)"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = companies.canonical_columns(company_rows(spark, sf_dir))
    return companies.validate(rows, countries=["IN", "US"])


@query(
    _CHECKED
    + "SELECT row_no, array_to_string(list_filter([CASE WHEN no_name THEN 'missing_required_field' END, CASE WHEN bad_url THEN 'malformed_url' END, CASE WHEN bad_ats THEN 'invalid_ats_type' END, CASE WHEN bad_category THEN 'invalid_company_category' END,"
    + f" CASE WHEN bad_country THEN 'unsupported_country' END, CASE WHEN dup_slug THEN 'duplicate_slug' END, CASE WHEN dup_url THEN 'duplicate_career_url' END], lambda x: x IS NOT NULL), ',') AS codes, NOT {_BAD} AS valid FROM checked"
)
def company_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("row_no", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "valid")


@query(_CHECKED + f"SELECT count(*) AS total, count(*) FILTER (NOT {_BAD}) AS valid, count(*) FILTER ({_BAD}) AS invalid, count(*) FILTER (dup_slug OR dup_url) AS duplicates FROM checked")
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.import_stats(_checked(spark, sf_dir))


@query(_CHECKED + f"SELECT row_no, array_to_string(list_filter([CASE WHEN no_name THEN 'missing_required_field:name' END, CASE WHEN bad_url THEN 'malformed_url:career_url' END, CASE WHEN bad_ats THEN 'invalid_ats_type:ats_type' END, CASE WHEN bad_category THEN 'invalid_company_category:company_category' END, CASE WHEN bad_country THEN 'unsupported_country:country' END, CASE WHEN dup_slug THEN 'duplicate_slug:slug' END, CASE WHEN dup_url THEN 'duplicate_career_url:career_url' END], lambda x: x IS NOT NULL), '; ') AS reason FROM checked WHERE {_BAD}")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.dead_letters(_checked(spark, sf_dir)).select("row_no", "reason")


@query(_CHECKED + f"SELECT slug, CASE WHEN CAST(substr(slug, 4) AS BIGINT) < 300 THEN 'update' ELSE 'insert' END AS action FROM checked WHERE NOT {_BAD}")
def company_import_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.range(300).select(F.concat(F.lit("co-"), F.col("id").cast("string")).alias("slug"))
    return companies.import_plan(_checked(spark, sf_dir).where("valid"), stored).select("slug", "action")


_DETECT = """CASE WHEN career_url LIKE '%greenhouse.io%' THEN 'greenhouse' WHEN career_url LIKE '%breezy.hr%' THEN 'breezyhr' WHEN career_url LIKE '%myworkdayjobs%' THEN 'workday' WHEN career_url LIKE '%lever.co%' THEN 'lever' ELSE 'unknown' END"""
_TOKEN = "CASE WHEN career_url LIKE '%greenhouse.io%' OR career_url LIKE '%breezy.hr%' THEN regexp_extract(career_url, '(co[0-9]+)', 1) END"


@query(_C + f"SELECT row_no, {_DETECT} AS ats_type, {_TOKEN} AS token, CASE WHEN {_DETECT} = 'unknown' THEN 0.0 WHEN {_DETECT} = 'lever' THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence FROM companies")
def ats_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_rows(spark, sf_dir).select("row_no", companies.detect_platform(F.col("career_url")).alias("d")).select("row_no", "d.ats_type", "d.token", "d.confidence")


@query(_C + f"SELECT row_no, CASE WHEN u THEN {_DETECT} ELSE ats_type END AS ats_type, CASE WHEN u THEN {_TOKEN} END AS ats_token, u AS updated FROM (SELECT *, coalesce(ats_type, 'unknown') = 'unknown' AND career_url IS NOT NULL AND {_DETECT} NOT IN ('unknown', 'lever') AS u FROM companies)")
def ats_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.fill_platforms(company_rows(spark, sf_dir)).select("row_no", "ats_type", "ats_token", "updated")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.sql("SELECT * FROM VALUES ('greenhouse', true), ('Lever', false), ('career_page', true) AS t(name, enabled)")
    return companies.route(company_rows(spark, sf_dir), sources, ["greenhouse", "career_page"])


_ROUTE = "CASE WHEN ats_type = 'greenhouse' THEN 'greenhouse' WHEN career_url IS NOT NULL THEN 'career_page' END"


@query(
    _C
    + f"SELECT row_no, {_ROUTE} AS collector, CASE WHEN ats_type = 'greenhouse' THEN 'ats' WHEN career_url IS NOT NULL THEN 'career_page' END AS strategy, "
    + "CASE WHEN ats_type = 'greenhouse' THEN 'matched ats collector ''greenhouse''' WHEN career_url IS NOT NULL THEN 'matched career_page collector ''career_page''' WHEN ats_type IN ('Lever', 'bogus') THEN concat('ats:''', ats_type, ''' disabled/absent') ELSE 'no ATS and no career URL' END AS reason FROM companies"
)
def company_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("row_no", "collector", "strategy", "reason")


@query(_C + f"SELECT coalesce({_ROUTE}, 'skipped') AS collector, count(*) AS n FROM companies GROUP BY 1")
def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.routing_summary(_decisions(spark, sf_dir))


@query(_C + f"SELECT {_ROUTE} AS collector, count(*) AS targets, min(slug) AS first_slug FROM companies WHERE {_ROUTE} IS NOT NULL GROUP BY 1")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.work_list(_decisions(spark, sf_dir)).groupBy("collector").agg(F.count("*").alias("targets"), F.min("slug").alias("first_slug"))


@query(_C + f"SELECT {_ROUTE} AS collector, slug, name, slug AS board_token, career_url FROM companies WHERE {_ROUTE} IS NOT NULL")
def work_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.work_list(_decisions(spark, sf_dir))


@query(_C + "SELECT company_category, CASE company_category WHEN 'automotive' THEN 'Automotive' WHEN 'saas' THEN 'Indian SaaS / Product' WHEN 'gcc' THEN 'GCC / Global Product (India)' WHEN 'startup' THEN 'Indian Startup' ELSE 'Other (sector)' END AS bucket, CASE company_category WHEN 'saas' THEN 1 WHEN 'startup' THEN 2 WHEN 'gcc' THEN 3 ELSE 5 END AS tier, CASE company_category WHEN 'saas' THEN 1.0 WHEN 'startup' THEN 0.8 WHEN 'gcc' THEN 0.6 ELSE 0.2 END::DOUBLE AS score, count(*) AS n FROM companies GROUP BY 1, 2, 3, 4")
def company_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("company_category")
    return company_rows(spark, sf_dir).groupBy("company_category", companies.bucket(c).alias("bucket"), companies.tier(c).alias("tier"), companies.priority(c).alias("score")).agg(F.count("*").alias("n"))


@query(ORACLE_JOBS + "SELECT company, CASE company WHEN 'Flipkart' THEN 0.8 WHEN 'Zomato' THEN 1.0 ELSE 0.5 END::DOUBLE AS company_priority, count(*) AS n FROM jobs_v GROUP BY 1, 2")
def priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.operators.rank import with_company_priority

    known = spark.sql("SELECT * FROM VALUES ('Flipkart', 0.2D, 0), ('flipkart ', 0.8D, 1), ('Zomato', 1.0D, 2), ('', 0.9D, 3) AS t(name, priority_score, ord)")
    rows = jobs_v(spark, sf_dir).withColumns({"company_name": F.col("company"), "canonical_company_name": F.lit(None).cast("string")})
    return with_company_priority(rows, known).groupBy("company", "company_priority").agg(F.count("*").alias("n"))


@query(
    "WITH m AS (SELECT s_suppkey AS seq, concat('co', CAST(s_suppkey % 40 AS VARCHAR)) AS slug, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('https://www.x', CAST(s_suppkey % 60 AS VARCHAR), '.example/jobs/') END AS career_url FROM supplier), "
    "f AS (SELECT slug, arg_min(seq, seq) AS seq, arg_min(career_url, seq) FILTER (career_url IS NOT NULL) AS any_url, arg_min(coalesce(career_url, ''), seq) AS own FROM m GROUP BY slug), "
    "g AS (SELECT slug, seq, any_url AS career_url, nullif(own, '') AS key FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM g) SELECT slug, seq, career_url FROM h WHERE key IS NULL OR k = 1"
)
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("co"), (F.col("s_suppkey") % 40).cast("string")).alias("slug"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("https://www.x"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".example/jobs/"))).alias("career_url"),
        F.col("s_name").alias("name"), F.lit(0.0).alias("priority_score"),
    )
    return companies.merge_seeds(rows, rows.limit(0)).select("slug", "seq", "career_url")


# --- runs and collectors: events stand for run facts

_FACTS = "SELECT concat('c', CAST(user_id % 5 AS VARCHAR)) AS collector, ts AS run_at, CAST(floor(value) AS BIGINT) AS jobs_found, CAST(floor(value / 4) AS BIGINT) AS duplicates, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, event_id % 1000 AS response_ms FROM events"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("collector"), F.col("ts").alias("run_at"), F.floor("value").cast("long").alias("jobs_found"),
        F.floor(F.col("value") / 4).cast("long").alias("duplicates"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"), (F.col("event_id") % 1000).alias("response_ms"),
    )


_RATES = f"""WITH f AS ({_FACTS}), s AS (SELECT collector, count(*) AS runs, CAST(sum(jobs_found) AS BIGINT) AS jobs, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(response_ms) AS BIGINT) AS total FROM f GROUP BY 1)
"""


@query(_RATES + "SELECT collector, runs, jobs, duplicates, errors, round(total / runs, 6) AS avg_response_ms, round((runs - errors) / runs, 6) AS success_rate, round(errors / runs, 6) AS error_rate, round(jobs / runs, 6) AS jobs_per_run, round(coalesce(duplicates / nullif(jobs, 0), 0), 6) AS duplicate_rate FROM s")
def collector_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = analytics.collector_rates(facts(spark, sf_dir))
    shown = ("avg_response_ms", "success_rate", "error_rate", "jobs_per_run", "duplicate_rate")
    return rates.select("collector", "runs", "jobs", "duplicates", "errors", *[F.round(c, 6).alias(c) for c in shown])


@query(_RATES + "SELECT collector, CAST(round(greatest(300, least(86400, 3600 * (1.0 / (1.0 + (jobs / runs) / 10.0)) * (1.0 + errors / runs * 4.0)))) AS BIGINT) AS seconds FROM s")
def adaptive_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = analytics.collector_rates(facts(spark, sf_dir))
    return rates.select("collector", F.round(runs.poll_interval(F.col("jobs_per_run"), F.col("error_rate"), F.col("runs"))).cast("long").alias("seconds"))


@query("SELECT event_id, CAST(least(3600, 30 * pow(2, user_id % 12)) AS BIGINT) AS seconds, CASE WHEN user_id % 12 >= 5 THEN 'exhausted' ELSE 'pending' END AS status FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 12).alias("attempts"), F.col("ts").cast("timestamp").alias("failed_at"))
    return runs.retry_tasks(failures).select("event_id", F.col("backoff_seconds").cast("long").alias("seconds"), "status")


@query("SELECT event_id AS task_id FROM events WHERE user_id % 12 < 5 AND ts + to_seconds(CAST(least(3600, 30 * pow(2, user_id % 12)) AS BIGINT)) <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts + to_seconds(CAST(least(3600, 30 * pow(2, user_id % 12)) AS BIGINT)), event_id LIMIT 50")
def retry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), (F.col("user_id") % 12).alias("attempts"), F.col("ts").cast("timestamp").alias("failed_at"))
    return runs.due_retries(runs.retry_tasks(failures), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("task_id")


@query("SELECT coalesce(bool_or(event_type = 'purchase' AND CAST(ts AS DATE) = DATE '2024-01-05'), FALSE) AS already_ran FROM events")
def already_ran_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    return runs.already_succeeded(rows, F.lit("2024-01-05 12:00:00").cast("timestamp"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


_PERF = "WITH r AS (SELECT event_id, ts, event_type, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100)\n"


@query(_PERF + "SELECT event_type AS stage, round(avg(user_id), 2) AS avg_ms FROM r GROUP BY 1")
def pipeline_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.lit(1.0).alias("duration_seconds"), *[F.lit(1).alias(c) for c in ("collected", "stored", "duplicates", "filtered_out")],
        F.array(F.struct(F.col("event_type").alias("name"), F.col("user_id").cast("double").alias("duration_ms"))).alias("stages"),
    )
    return analytics.pipeline_performance(rows)[1]


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN c_custkey % 7 = 2 ELSE FALSE END AND c_custkey % 24 <= 10 AS due FROM customer")
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules from customers at a Wednesday, 10 o'clock; monthly ones name another day."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit(True).alias("enabled"), F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly")), (k % 3 + 1).cast("int")).alias("frequency"), (k % 24).alias("hour"),
        (k % 7).alias("weekday"), F.lit(5).alias("day_of_month"), F.lit(None).cast("timestamp").alias("last_run_at"),
    )
    return rows.select("c_custkey", runs.is_due(F.lit("2026-07-22 10:00:00").cast("timestamp")).alias("due"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN value * 100 > 5000 THEN 'response_ms' END, CASE WHEN user_id > 120 THEN 'crawl_seconds' END], lambda x: x IS NOT NULL), ',') AS violations FROM events")
def budget_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.budget_violations(F.col("value") * 100, F.col("user_id").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(found, lambda v: v["metric"]), ",").alias("violations"))


_STATES = "CASE event_type WHEN 'signup' THEN 'idle' WHEN 'view' THEN 'syncing' WHEN 'purchase' THEN 'backoff' WHEN 'error' THEN 'failed' ELSE 'disabled' END"
_LEGAL = " OR ".join(f"(b = {q(s)} AND state IN ({', '.join(map(q, to))}))" for s, to in runs.TRANSITIONS.items())


@query(f"WITH e AS (SELECT event_id, user_id, ts, {_STATES} AS state FROM events), x AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'idle') AS b FROM e) SELECT event_id, b AS before, (state = b OR {_LEGAL}) AS legal FROM x")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("collector"), F.col("ts").alias("at"), F.expr(_STATES).alias("state"))
    return runs.transitions(events).select("event_id", "before", "legal")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 14).select("event_id")


@query("SELECT user_id AS collector, count(*) - count(DISTINCT event_type) AS duplicates FROM events GROUP BY 1")
def collector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.collector_duplicates(table(spark, sf_dir, "events").select(F.col("user_id").alias("collector"), F.col("event_type").alias("external_id")))


@query("SELECT event_id, CASE WHEN event_type = 'signup' AND user_id % 3 > 0 THEN 'failed' WHEN user_id % 2 = 0 AND user_id % 5 = 0 THEN 'failed' WHEN user_id % 2 = 0 OR user_id % 7 > 0 THEN CASE WHEN user_id % 3 > 0 THEN 'partial' ELSE 'success' END ELSE 'failed' END AS status FROM events")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    status = runs.run_status(F.when(F.col("event_type") == "signup", 0).otherwise(10), u % 3, F.when(u % 2 == 0, "").otherwise("me@x"), u % 5 == 0, u % 7 > 0)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


# --- collections and sources


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def collection_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return store.find(rows, "o_orderstatus = 'F' AND o_totalprice >= 1000", [F.desc("o_totalprice"), "o_orderkey"], 50, 25).select("o_orderkey", "o_totalprice")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS priority FROM nation")
def registry_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("priority"))
    return registry.overlaid(base, base.where("priority % 2 = 0").withColumn("priority", F.col("priority") + 100))


@query("SELECT CASE WHEN n_regionkey < 2 THEN 'ats' ELSE 'job_board' END AS source_type, CASE WHEN n_nationkey % 5 = 0 THEN 'scrape' ELSE 'api' END AS legal_mode, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS enabled FROM nation GROUP BY 1, 2")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 2, "ats").otherwise("job_board").alias("source_type"),
        F.when(F.col("n_nationkey") % 5 == 0, "scrape").otherwise("api").alias("legal_mode"), (F.col("n_nationkey") % 2 == 0).alias("enabled"),
    )
    return registry.stats(rows)


@query(ORACLE_JOBS + "SELECT external_id, title, company, url, location, description FROM jobs_v WHERE description IS NOT NULL OR TRUE")
def ats_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as one platform's JSON and read back through its projection."""
    rows = jobs_v(spark, sf_dir)
    body = F.struct(F.col("external_id").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct("location").alias("categories"), F.col("description").alias("descriptionPlain"))
    read = ats.raw_jobs(rows.select("company", F.to_json(body).alias("raw"), F.col("location").alias("was")), "lever")
    return read.select("external_id", "title", "company", "url", F.when(F.get_json_object("raw", "$.categories.location") == "", "").otherwise(F.col("location")).alias("location"), "description")


@query("SELECT event_id, epoch_us(CASE user_id % 4 WHEN 0 THEN TIMESTAMP '2024-02-01' - to_days(CAST(event_id % 9 AS INTEGER)) WHEN 1 THEN TIMESTAMP '2024-01-31' WHEN 2 THEN make_timestamp(CAST(1700000000 + event_id AS BIGINT) * 1000000) END) AS posted FROM events")
def freshness_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("user_id") % 4, F.col("event_id")
    text = F.when(k == 0, F.concat((e % 9).cast("string"), F.lit(" days ago"))).when(k == 1, "Yesterday").when(k == 2, (1700000000 + e).cast("string")).otherwise("soon")
    at = parse.posted(text, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(at).alias("posted"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_hiring_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from a stream over the events files."""
    one = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(one.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return trends.run_available(trends.daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "trend", ["day"])


@query("SELECT user_id, event_type, min(ts) AS first_at, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type, moment) once from a stream over the events files, however often it comes."""
    one = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(one.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    keyed = stream.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("posted_date"), F.concat_ws("|", "user_id", "event_type", "ts").alias("job_hash"))
    rows = trends.run_available(trends.first_seen(keyed), "first", ["job_hash"])
    return rows.groupBy("user_id", "event_type").agg(F.min("posted_date").alias("first_at"), F.count("*").alias("n"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")


_PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events)"


@query(f"WITH e AS (SELECT event_id, user_id, ts, {_STATES} AS state FROM events), x AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'idle') AS b FROM e) SELECT event_id, b AS before, (state = b OR {_LEGAL}) AS legal FROM x WHERE {_PASSED}")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``state_transitions`` from a stream, with keyed state and timers: all events that the watermark has passed."""
    events = _event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("collector"), F.col("ts").cast("timestamp").alias("at"), F.expr(_STATES).alias("state"))
    folder = f"{shared_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    return stateful.drain(stateful.state_stream(events), folder).select("event_id", "before", "legal")


@query(
    f"""WITH e AS (SELECT *, epoch_ms(ts) AS ms, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS run, lead(epoch_ms(ts)) OVER w AS next_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, event_type = 'purchase' ORDER BY ts, event_id) AS attempts, least(3600, 30 * pow(2, least(20, row_number() OVER (PARTITION BY user_id, run, event_type = 'purchase' ORDER BY ts, event_id) - 1))) AS wait FROM e),
s AS (SELECT user_id, event_id, ms, next_ms, attempts, wait, CASE WHEN event_type = 'purchase' THEN 'done' WHEN attempts > 5 THEN 'exhausted' ELSE 'pending' END AS status FROM a WHERE {_PASSED})
SELECT user_id AS task_id, event_id, status, CASE WHEN status = 'pending' THEN wait ELSE 0 END::BIGINT AS wait FROM s
UNION ALL SELECT user_id, NULL, 'due', 0 FROM s WHERE status = 'pending' AND ms + wait * 1000 < (SELECT epoch_ms(max(ts)) FROM events) AND (next_ms IS NULL OR next_ms > ms + wait * 1000)"""
)
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of tasks in a stream: users are tasks, a purchase ends their failures."""
    kind = F.when(F.col("event_type") == "purchase", "done").otherwise("failure")
    events = _event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    folder = f"{shared_dir(spark).rstrip('/')}/retries-{uuid.uuid4().hex}"
    return stateful.drain(stateful.retry_stream(events), folder).select("task_id", "event_id", "status", F.col("backoff_seconds").cast("long").alias("wait"))


@query("SELECT s_suppkey AS seq, s_name AS name, concat('https://x.example/', CAST(s_suppkey AS VARCHAR)) AS career_url FROM supplier")
def seed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid lines made from suppliers, read as a seed table; half the lines are rules or headers."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("| "), F.col("s_name"), F.lit("   noise | https://x.example/"), F.col("s_suppkey").cast("string"), F.lit(".; |"))
    lines = s.select(F.col("s_suppkey").alias("seq"), line.alias("value")).unionByName(s.select(F.col("s_suppkey").alias("seq"), F.lit("+----+=====+").alias("value")))
    return files.seed_entries(lines)
