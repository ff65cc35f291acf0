"""Queries over the life of stored data: embeddings, resumes, counters, seeds, stamps, boards and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.operators import analytics, companies, embeddings, exports, rank, runs, search
from talentlake.plans import filters
from talentlake.plans import oracle as o
from talentlake.plans.job_queries import RESUME, jobs, now
from talentlake.plans.jobs_view import NOW, ORACLE_JOBS, jobs_v, table
from talentlake.plans.normalize import job_text
from talentlake.plans.other_queries import _SCORED, QUERY, company_rows, facts
from talentlake.plans.registry import query
from talentlake.plans.registry import sql_text as q
from talentlake.sources import ats, files

MODEL = embeddings.Model("hashing", 64)


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with embeddings in four states by id: none, of an old model, of another text, fresh."""
    k = F.pmod("doc_id", F.lit(4))
    meta = F.struct(
        F.when(k == 1, "old").otherwise("hashing").alias("model_name"), F.lit(1).alias("embedding_version"), F.lit(64).alias("dimensions"),
        F.when(k == 2, "of another text").otherwise(embeddings.content_hash(F.col("text"))).alias("content_hash"), now().alias("generated_at"),
    )
    vector = F.array_repeat(F.lit(0.5).cast("float"), 64)
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k > 0, vector).alias("embedding"), F.when(k > 0, meta).alias("embedding_meta"))


@query("SELECT doc_id, doc_id % 4 <> 3 AS renewed, 'hashing' AS model_name, 64 AS dimensions, sha256(text) AS content_hash, 64 AS size, doc_id % 4 = 3 AS kept FROM documents")
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what isn't fresh is embedded; a fresh row keeps the vector it had."""
    done = embeddings.embed(_stored_documents(spark, sf_dir), F.col("text"), MODEL, now())
    was = F.forall("embedding", lambda x: x == 0.5)
    return done.select("doc_id", "renewed", "embedding_meta.model_name", "embedding_meta.dimensions", "embedding_meta.content_hash", F.size("embedding").alias("size"), was.alias("kept"))


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 4 = 3) AS skipped, count(*) FILTER (doc_id % 4 <> 3) AS embedded FROM documents")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embed_stats(embeddings.embed(_stored_documents(spark, sf_dir), F.col("text"), MODEL, now()))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'none' ELSE 'old' END AS model_name, count(*) AS n FROM documents WHERE doc_id % 4 < 2 GROUP BY 1")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.from_models(_stored_documents(spark, sf_dir), MODEL)


@query("SELECT doc_id, doc_id % 4 < 2 AS migrated, 'hashing' AS model_name FROM documents")
def migrated_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = embeddings.migrate(_stored_documents(spark, sf_dir), F.col("text"), MODEL, now())
    return done.select("doc_id", F.col("renewed").alias("migrated"), "embedding_meta.model_name")


@query(
    "SELECT c_custkey AS resume_id, c_custkey % 3 > 0 AS regenerated, CASE WHEN c_custkey % 3 = 0 THEN concat('old ', c_name) WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN concat('old ', c_name) END AS label, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'SQL' WHEN c_custkey % 5 = 0 THEN 'Python' WHEN c_custkey % 3 = 1 THEN 'SQL' ELSE '' END AS skills, sha256(CASE WHEN c_custkey % 3 = 0 THEN c_comment ELSE c_comment END) AS content_hash FROM "
    "(SELECT c_custkey, c_name, concat(c_mktsegment, ' ', CAST(c_nationkey AS VARCHAR)) AS c_comment FROM customer)"
)
def resume_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resumes: a third unchanged, a third changed, a third new; labels and skills that a request leaves out stay as stored."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("content"))
    stored = base.where(k % 3 < 2).select(
        k.alias("resume_id"), F.concat(F.lit("old "), "c_name").alias("label"), F.array(F.lit("SQL")).alias("skills"), none.alias("preferred_locations"), F.lit(2.0).alias("max_experience_years"),
        embeddings.content_hash(F.when(k % 3 == 0, F.col("content")).otherwise("another")).alias("content_hash"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"), F.lit("hashing").alias("model_name"),
        F.lit(1).alias("embedding_version"), F.lit(64).alias("dimensions"), now().alias("generated_at"),
    )
    requests = base.select(
        k.alias("resume_id"), "content", F.when(k % 2 == 0, F.col("c_name")).alias("label"), F.when(k % 5 == 0, F.array(F.lit("Python"))).otherwise(none).alias("skills"),
        none.alias("preferred_locations"), F.lit(3.0).alias("max_experience_years"),
    )
    done = embeddings.embed_resumes(requests, stored, MODEL, now())
    return done.select("resume_id", "regenerated", "label", F.array_join("skills", ";").alias("skills"), "content_hash")


_NAMES = (*embeddings.MODELS, "some/other")


@query(
    f"SELECT p_partkey, concat(CASE WHEN m < 2 THEN 'Represent this resume for retrieving relevant job descriptions: ' WHEN m = 2 THEN 'query: ' ELSE '' END, p_name) AS query, concat(CASE WHEN m = 2 THEN 'passage: ' ELSE '' END, p_name) AS document, "
    f"CASE m WHEN 1 THEN 768 WHEN 2 THEN 768 WHEN 4 THEN 96 ELSE 384 END AS dimensions FROM (SELECT p_partkey, p_name, p_partkey % {len(_NAMES)} AS m FROM part)"
)
def model_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model reads for a text as a query and as a document."""
    models = [embeddings.model_of(n, 96) for n in _NAMES]
    pick = lambda value: F.element_at(F.array(*[value(m) for m in models]), (F.col("p_partkey") % len(models) + 1).cast("int"))
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", pick(lambda m: embeddings.model_text(name, m, query=True)).alias("query"), pick(lambda m: embeddings.model_text(name, m)).alias("document"), pick(lambda m: F.lit(m.dimensions)).alias("dimensions")
    )


_STEP = "CASE event_type WHEN 'signup' THEN 'ai_embed_query_seconds' WHEN 'view' THEN 'ai_vector_search_seconds' WHEN 'purchase' THEN 'cache_hit' WHEN 'error' THEN 'cache_miss' ELSE 'ai_rank_seconds' END"
_MEAN = lambda name: f"round(coalesce(avg(s) FILTER (name = {q(name)}), 0) * 1000, 3)"


@query(f"WITH e AS (SELECT {_STEP} AS name, user_id / 128 AS s FROM events) SELECT {', '.join(f'{_MEAN(v)} AS {k}' for k, v in embeddings.STEPS.items())}, count(*) FILTER (name = 'cache_hit') AS hits, count(*) FILTER (name = 'cache_miss') AS misses, coalesce(count(*) FILTER (name = 'cache_hit') / nullif(count(*) FILTER (name IN ('cache_hit', 'cache_miss')), 0), 0) AS hit_rate FROM e")
def ai_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.metrics_report(table(spark, sf_dir, "events").select(F.expr(_STEP).alias("name"), (F.col("user_id") / 128).alias("seconds")))


# --- counters, stamps and seeds


@query(
    "SELECT concat('c', CAST(user_id % 5 AS VARCHAR)) AS collector, count(*) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_jobs_found, CAST(sum(CAST(floor(value / 4) AS BIGINT)) AS BIGINT) AS total_duplicates, "
    "count(*) FILTER (event_type = 'error') AS total_errors, CAST(sum(event_id % 1000) AS DOUBLE) AS total_response_ms, count(*) AS response_samples FROM events GROUP BY 1"
)
def record_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after two increments: some of the runs into nothing, then the others into those."""
    all_facts = facts(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("run_at", "response_ms"), F.lit(2)))
    none = spark.createDataFrame([], "collector string, runs long, total_jobs_found long, total_duplicates long, total_errors long, total_response_ms double, response_samples long, last_run_at timestamp")
    first = analytics.record_runs(none, all_facts.where("part = 0"))
    return analytics.record_runs(first, all_facts.where("part = 1")).select("collector", *analytics.COUNTERS)


@query("SELECT o_orderkey, 'run_7' AS run_id, 'cor_7' AS correlation_id FROM orders")
def run_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_run(table(spark, sf_dir, "orders").select("o_orderkey"), runs.run_ids("run_7", "cor_7"))


@query("SELECT 1 AS report_version, 3 AS schema_version, '2.0' AS pipeline_version, array_to_string(list_sort(list(concat(s, '=', v))), ',') AS collectors FROM (SELECT concat('s', CAST(o_orderkey % 3 AS VARCHAR)) AS s, max(concat('1.', CAST(o_orderkey % 7 AS VARCHAR))) AS v FROM orders GROUP BY 1)")
def version_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = runs.versions(table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("1."), (k % 7).cast("string")).alias("collector_version")))
    pairs = F.transform(F.map_entries("collector_versions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.select("report_version", "schema_version", "pipeline_version", F.array_join(F.array_sort(pairs), ",").alias("collectors"))


_SEED = "SELECT s_suppkey, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN concat('https://boards.greenhouse.io/x', CAST(s_suppkey AS {text})) WHEN 1 THEN 'https://jobs.lever.co/' WHEN 2 THEN 'https://own.example/jobs' END AS career_url, CASE s_suppkey % 3 WHEN 0 THEN 'workday' WHEN 1 THEN '' END AS ats_type, CASE WHEN s_suppkey % 5 = 0 THEN 'US' END AS country, CASE WHEN s_suppkey % 6 = 0 THEN TRUE END AS remote_support, s_suppkey % 7 = 0 AS from_seed FROM {supplier}"
_SEEDED = f"""WITH s AS ({_SEED.format(text="VARCHAR", supplier="supplier")}), e AS (SELECT *, coalesce(nullif(ats_type, ''), 'unknown') = 'unknown' AND s_suppkey % 4 < 2 AS hit FROM s),
f AS (SELECT s_suppkey, coalesce(country, 'IN') AS country, CASE WHEN hit AND s_suppkey % 4 = 0 THEN 'greenhouse' WHEN hit THEN 'lever' ELSE coalesce(nullif(ats_type, ''), 'unknown') END AS ats_type, CASE WHEN hit AND s_suppkey % 4 = 0 THEN concat('x', CAST(s_suppkey AS VARCHAR)) END AS ats_token,
  CASE WHEN hit AND s_suppkey % 4 = 0 THEN 'Greenhouse' WHEN hit THEN 'Lever' END AS career_platform, coalesce(remote_support, FALSE) AS remote_support, hit AS ats_detected, from_seed FROM e)
"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.enrich_seeds(spark.sql(_SEED.replace("{text}", "STRING"), supplier=table(spark, sf_dir, "supplier")))


@query(_SEEDED + "SELECT s_suppkey, country, ats_type, ats_token, career_platform, remote_support, ats_detected, 'weekly' AS crawl_frequency, 50 AS priority_score FROM f")
def seed_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir).select("s_suppkey", "country", "ats_type", "ats_token", "career_platform", "remote_support", "ats_detected", "crawl_frequency", "priority_score")


@query(_SEEDED + "SELECT count(*) AS total, count(*) FILTER (from_seed) AS from_seed_only, count(*) FILTER (NOT from_seed) AS from_metadata, count(*) FILTER (ats_detected) AS ats_detected, count(*) FILTER (ats_type <> 'unknown') AS with_known_ats, count(*) FILTER (remote_support) AS remote_supported FROM f")
def seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.seed_stats(_seeds(spark, sf_dir))


@query(_SEEDED + "SELECT ats_type AS value, count(*) AS n FROM f GROUP BY 1")
def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.seed_counts(_seeds(spark, sf_dir), "ats_type")


@query(f"SELECT 'c.csv' AS source, 'abc' AS checksum, TIMESTAMP '{NOW}' AS imported_at, count(*) AS total, count(*) AS valid, 0 AS invalid, 0 AS duplicates, count(*) FILTER (n_nationkey >= 10) AS inserted, count(*) FILTER (n_nationkey < 10) AS updated FROM nation")
def import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_no"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"))
    stored = rows.where("row_no < 10").select("slug")
    return companies.import_history(companies.validate(rows), stored, "c.csv", "abc", now())


# --- postings


@query(f"{o.JOBS[:-1]}, s AS (SELECT seq, city, country, is_remote, employment_type FROM jobs) SELECT seq, array_to_string(list_filter([CASE WHEN is_remote THEN 'remote' END, lower(city), lower(country), CASE WHEN employment_type <> 'unknown' THEN employment_type END], lambda x: x IS NOT NULL), ',') AS tags FROM s")
def job_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("seq", F.array_join("tags", ",").alias("tags"))


_TEXT = "concat_ws(' ', title, description)"


@query(f"{ORACLE_JOBS.rstrip()}, s AS (SELECT *, {o.skills(_TEXT, o.ALL_SKILLS)} AS a, {o.skills(_TEXT, tuple(c for c in o.ALL_SKILLS if c != 'soft_skills'))} AS b FROM jobs_v) SELECT seq, trim(concat_ws(' ', title, array_to_string(a, ' '), array_to_string(b, ' '), description)) AS text FROM s")
def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is embedded for a job."""
    rows = jobs(spark, sf_dir)
    return rows.select("seq", job_text(rows).alias("text"))


@query(o.JOBS + "SELECT seq FROM jobs WHERE level IN ('fresher', 'entry', 'junior', 'associate') OR coalesce(min_years, 0) <= 2")
def filter_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.passed(filters.with_rejection(jobs(spark, sf_dir), [filters.experience()])).select("seq")


_EXPORT = f"{ORACLE_JOBS.rstrip()}, {o.salary('jobs_v')} SELECT seq, coalesce(min_amount, -1) AS salary_min, coalesce(max_amount, -1) AS salary_max, coalesce(currency, '') AS currency, strftime(CAST(posted_date AS DATE), '%Y-%m-%d') AS posted_date, '' AS career_url, array_to_string({o.skills(_TEXT, o.ALL_SKILLS)}, '; ') AS skills FROM paid"


@query(_EXPORT)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further columns of exported rows, a null figure as -1."""
    flat = exports.job_rows(jobs(spark, sf_dir))
    figure = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return flat.select("seq", figure("salary_min"), figure("salary_max"), "currency", "posted_date", "career_url", "skills")


@query()
def rerank_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored jobs ranked anew for a resume; no SQL, as the embedding's hash is unknown there."""
    from talentlake.functions.vectors import Hasher

    resume = rank.Resume("ai", [float(x) for x in Hasher().encode(["python pytorch rag machine learning engineer"])[0]], RESUME.skills, RESUME.preferred_locations)
    return rank.rerank_stored(jobs(spark, sf_dir), resume, now(), None).select("seq", "match.score", "match.similarity", "match.company_priority")


@query(f"SELECT vec_id, label, round(score, 4) AS score FROM ({_SCORED}) WHERE label <> 2 ORDER BY score DESC, vec_id LIMIT 15 OFFSET 5")
def search_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with filter, page, rounded scores and the rows of the hits."""
    found = search.search(table(spark, sf_dir, "embeddings"), "vec_id", query=QUERY, limit=15, skip=5, where=F.col("label") != 2)
    return found.select("vec_id", "label", "score")


# --- platforms: each posting as the JSON of one of the fifteen boards, dealt by its number


def _bodies() -> dict:
    c, s, lit = F.col, F.struct, F.lit
    id_, title, url, place, text = c("external_id"), c("title"), c("url"), c("location"), c("description")
    return {
        "greenhouse": s(id_.alias("id"), title.alias("title"), url.alias("absolute_url"), s(place.alias("name")).alias("location"), text.alias("content"), lit("2024-01-02T03:04:05Z").alias("updated_at")),
        "lever": s(id_.alias("id"), title.alias("text"), url.alias("hostedUrl"), s(place.alias("location")).alias("categories"), text.alias("descriptionPlain"), lit(1704164645000).alias("createdAt")),
        "ashby": s(id_.alias("id"), title.alias("title"), url.alias("applyUrl"), place.alias("location"), text.alias("descriptionPlain"), lit("2024-01-02T03:04:05Z").alias("publishedAt")),
        "workday": s(F.array(id_).alias("bulletFields"), title.alias("title"), url.alias("externalPath"), place.alias("locationsText")),
        "smartrecruiters": s(id_.alias("id"), title.alias("name"), url.alias("ref"), s(place.alias("city"), lit("in").alias("country")).alias("location"), s(s(s(text.alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd"), lit("2024-01-02T03:04:05Z").alias("releasedDate")),
        "bamboohr": s(id_.alias("id"), title.alias("jobOpeningName"), url.alias("jobOpeningUrl"), s(place.alias("city"), lit("").alias("state")).alias("location"), lit(False).alias("isRemote"), lit("2024-01-02T03:04:05Z").alias("datePosted")),
        "teamtailor": s(id_.alias("id"), s(title.alias("title"), text.alias("body"), place.alias("location"), lit("fully").alias("remote-status"), lit("2024-01-02T03:04:05Z").alias("created-at")).alias("attributes"), s(url.alias("careersite-job-url")).alias("links")),
        "recruitee": s(id_.alias("id"), title.alias("title"), url.alias("careers_url"), place.alias("city"), lit("DE").alias("country"), text.alias("description"), lit("2024-01-02T03:04:05Z").alias("published_at")),
        "jobvite": s(lit("").alias("eId"), id_.alias("id"), title.alias("title"), url.alias("jobUrl"), place.alias("location"), text.alias("detail"), lit("2024-01-02T03:04:05Z").alias("date")),
        "icims": s(id_.alias("jobId"), title.alias("jobTitle"), url.alias("url"), place.alias("location"), text.alias("description"), lit("2024-01-02T03:04:05Z").alias("postedDate")),
        "oracle": s(id_.alias("Id"), title.alias("Title"), url.alias("ExternalUrl"), place.alias("PrimaryLocation"), text.alias("ExternalDescriptionStr"), lit("2024-01-02T03:04:05Z").alias("PostedDate")),
        "successfactors": s(id_.alias("jobReqId"), title.alias("externalTitle"), url.alias("postingUrl"), place.alias("location"), text.alias("jobDescription"), lit("/Date(1704164645000)/").alias("postedDate")),
        "comeet": s(id_.alias("uid"), title.alias("name"), url.alias("url_active_page"), s(place.alias("city"), lit("IN").alias("country")).alias("location"), text.alias("details"), lit("2024-01-02T03:04:05Z").alias("time_updated")),
        "breezyhr": s(id_.alias("_id"), title.alias("name"), url.alias("url"), s(place.alias("city"), s(lit("India").alias("name")).alias("country"), lit(True).alias("is_remote")).alias("location"), text.alias("description"), lit("2024-01-02T03:04:05Z").alias("published_date")),
        "jazzhr": s(id_.alias("id"), title.alias("title"), url.alias("apply_url"), place.alias("city"), lit("KA").alias("state"), text.alias("description"), lit("2024-01-02T03:04:05Z").alias("original_open_date")),
    }


BOARD_NAMES = tuple(ats.BOARDS)
_ENDS = {"smartrecruiters": "in", "recruitee": "DE", "comeet": "IN", "jazzhr": "KA"}
_JOINED = " ".join(f"WHEN {q(k)} THEN concat_ws(', ', nullif(location, ''), {q(v)})" for k, v in _ENDS.items())


@query(
    f"{ORACLE_JOBS.rstrip()}, p AS (SELECT *, [{', '.join(map(q, BOARD_NAMES))}][seq % {len(BOARD_NAMES)} + 1] AS platform FROM jobs_v) SELECT platform, external_id, title, url, CASE platform WHEN 'teamtailor' THEN 'Remote' WHEN 'breezyhr' THEN 'Remote' {_JOINED} ELSE nullif(location, '') END AS location, "
    "CASE WHEN platform NOT IN ('workday', 'bamboohr') THEN description END AS description, CASE WHEN platform <> 'workday' THEN 1704164645 END AS posted FROM p"
)
def board_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings landed as each platform's JSON and read back through its projection, in one table of all collectors."""
    rows = jobs_v(spark, sf_dir)
    read = {}
    for k, (name, body) in enumerate(_bodies().items()):
        landed = rows.where(F.pmod("seq", F.lit(len(BOARD_NAMES))) == BOARD_NAMES.index(name)).select("company", F.to_json(body).alias("raw"))
        read[name] = ats.raw_jobs(landed, name)
    both = files.collected(read)
    return both.select(F.col("collector").alias("platform"), "external_id", "title", "url", "location", "description", F.unix_seconds("posted_at").alias("posted"))
