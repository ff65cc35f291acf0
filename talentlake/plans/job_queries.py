"""Queries over postings: normalisation, filters, dedup, analytics, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions import parse, terms
from talentlake.functions.text import content_tokens, fingerprint, url_key
from talentlake.functions.vectors import Hasher, hash_embedding, text_cosine
from talentlake.operators import analytics, store
from talentlake.operators.rank import Resume, best_matches, rank, scores
from talentlake.operators.shared import written
from talentlake.plans import dedup, filters
from talentlake.plans import oracle as o
from talentlake.plans.jobs_view import NOW, ORACLE_JOBS, jobs_v, table
from talentlake.plans.normalize import job_text, normalize, resolve_aliases
from talentlake.plans.registry import query
from talentlake.plans.registry import sql_text as q

MAX_HOURS = 24.0 * 400
#: Alias groups of the sample companies.
ALIASES = (("Google", "alphabet", "Alphabet"), ("Alphabet", "alphabet", "Alphabet"), ("Facebook", "meta", "Meta"), ("Meta", "meta", "Meta"), ("AWS", "amazon", "Amazon"), ("Grofers", "blinkit", "Blinkit"))
RESUME = Resume("ai", skills=("Python", "PyTorch", "Docker", "SQL"), preferred_locations=("Bangalore", "IN"), max_experience_years=2.0)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def aliases(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({q(a)}, {q(s)}, {q(c)}, {k})" for k, (a, s, c) in enumerate(ALIASES))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(alias, slug, canonical, ord)")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(jobs_v(spark, sf_dir), now(), aliases(spark))


@query(o.JOBS + f"SELECT coalesce({o.rejected_by(NOW, MAX_HOURS)}, 'passed') AS rejected_by, count(*) AS n FROM jobs GROUP BY 1")
def funnel_rejected_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.summary(filters.with_rejection(filters.validated(jobs_v(spark, sf_dir)).transform(lambda d: normalize(d, now())), filters.default_chain(now(), max_hours=MAX_HOURS)))


@query(o.JOBS + f"SELECT seq, title, normalized_role FROM jobs WHERE {o.rejected_by(NOW, MAX_HOURS)} IS NULL")
def filter_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.passed(filters.with_rejection(jobs(spark, sf_dir), filters.default_chain(now(), max_hours=MAX_HOURS))).select("seq", F.col("role").alias("title"), "normalized_role")


@query(o.JOBS + "SELECT seq FROM jobs WHERE is_remote OR list_has_any(list_filter([lower(city), lower(country)], lambda x: x IS NOT NULL), ['bangalore', 'us'])")
def filter_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.passed(filters.with_rejection(jobs(spark, sf_dir), [filters.location(("Bangalore", "US"))])).select("seq")


@query(o.JOBS + "SELECT seq, min_years, max_years, level FROM jobs")
def normalize_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_v(spark, sf_dir).select("seq", parse.experience(F.col("description")).alias("e")).select("seq", "e.*")


@query(f"{ORACLE_JOBS.rstrip()}, {o.salary('jobs_v')} SELECT seq, min_amount, max_amount, currency, period FROM paid")
def normalize_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_v(spark, sf_dir).select("seq", parse.salary(F.col("description")).alias("s")).select("seq", "s.*")


@query(o.JOBS + "SELECT employment_type, count(*) AS n FROM jobs GROUP BY 1")
def normalize_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = parse.employment_type(F.concat_ws(" ", "title", "description"))
    return jobs_v(spark, sf_dir).groupBy(kind.alias("employment_type")).agg(F.count("*").alias("n"))


@query(o.JOBS + "SELECT seq, city, country, work_mode, is_remote FROM jobs")
def normalize_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_v(spark, sf_dir).select("seq", parse.place(F.col("location")).alias("p")).select("seq", "p.city", "p.country", "p.work_mode", "p.is_remote")


@query(o.JOBS + "SELECT title, normalized_role, count(*) AS n FROM jobs GROUP BY 1, 2")
def normalize_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_v(spark, sf_dir).groupBy("title", parse.role(F.col("title")).alias("normalized_role")).agg(F.count("*").alias("n"))


_TEXT = "concat_ws(' ', title, description)"
_SKILLS = f"{ORACLE_JOBS.rstrip()}, skilled AS (SELECT seq, {o.skills(_TEXT, o.ALL_SKILLS)} AS listed, {o.skills(_TEXT, terms.TECHNICAL)} AS technical FROM jobs_v)\n"


@query(_SKILLS + "SELECT seq, array_to_string(listed, ';') AS skills FROM skilled")
def skills_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs_v(spark, sf_dir).select("seq", F.lower(F.concat_ws(" ", "title", "description")).alias("low"))
    _, found, _ = terms.extract_skills(terms.skills_by_category(F.col("low"), lowered=True))
    return rows.select("seq", F.array_join(found, ";").alias("skills"))


@query(_SKILLS + "SELECT k AS key, count(*) AS n FROM (SELECT seq, unnest(listed) AS k FROM skilled) GROUP BY 1 ORDER BY 2 DESC, min(seq), 1 LIMIT 10")
def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_counts(jobs(spark, sf_dir), F.col("skills"), 10, explode=True)


@query(
    _SKILLS
    + """, x AS (SELECT seq, unnest(listed) AS k FROM skilled)
SELECT k AS key, count(*) AS n FROM x WHERE lower(k) NOT IN ('python', 'pytorch', 'docker', 'sql') GROUP BY 1 ORDER BY 2 DESC, min(seq), 1 LIMIT 20"""
)
def skill_gap_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missing_skills(rank(jobs(spark, sf_dir), RESUME, now()))


@query(f"SELECT page_id, {o.url_key('url')} AS url_key FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_key(F.col("url")).alias("url_key"))


@query(ORACLE_JOBS + f"SELECT count(DISTINCT {o.url_key('url')}) AS urls, count(*) AS n FROM jobs_v")
def url_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_v(spark, sf_dir).agg(F.count_distinct(url_key(F.col("url"))).alias("urls"), F.count("*").alias("n"))


@query(f"SELECT doc_id, {o.fingerprint('text')} AS fingerprint FROM documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


_PRINTS = ORACLE_JOBS + f", f AS (SELECT seq, {o.fingerprint('''concat_ws(' ', title, description)''')} AS fp FROM jobs_v)\n"


@query(_PRINTS + "SELECT fp AS content_fingerprint, count(*) AS count FROM f WHERE fp <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.duplicate_groups(jobs(spark, sf_dir)).select("content_fingerprint", "count")


@query(f"{o.JOBS[:-1]}, f AS (SELECT seq, concat(normalized_role, ' @ ', company) AS label, {o.fingerprint(_TEXT)} AS fp FROM jobs), g AS (SELECT *, count(*) OVER (PARTITION BY fp) AS n, min(seq) OVER (PARTITION BY fp) AS first FROM f WHERE fp <> '') SELECT fp AS content_fingerprint, n AS count, first, seq, label FROM g WHERE n > 1")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.duplicate_members(jobs(spark, sf_dir))


_WORDS = lambda x: f"array_to_string(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), ' ')"
_PLACE = "concat_ws(' ', coalesce(city, ''), coalesce(country, ''))"


@query(o.JOBS + f"SELECT seq, sha256(concat_ws('|', {_WORDS('company')}, {_WORDS('normalized_role')}, {_WORDS(_PLACE)}, {o.url_key('url')})) AS job_hash FROM jobs")
def job_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("seq", "job_hash")


_ALIAS = f"(VALUES {', '.join(f'({q(a.lower())}, {q(s)}, {q(c)})' for a, s, c in ALIASES)}) a(alias, slug, canonical)"


@query(ORACLE_JOBS + f"SELECT company, a.canonical AS canonical_company_name, a.slug AS company_slug, count(*) AS n FROM jobs_v LEFT JOIN {_ALIAS} ON lower(trim(company)) = a.alias GROUP BY 1, 2, 3")
def alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_aliases(jobs_v(spark, sf_dir), aliases(spark)).groupBy("company", "canonical_company_name", "company_slug").agg(F.count("*").alias("n"))


@query()
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: acceptance depends on acceptance; tests replay it row by row."""
    return dedup.deduplicate(jobs(spark, sf_dir))




@query(
    "WITH t AS (SELECT o_custkey % 500 AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders), x AS (SELECT k AS id, list_distinct(list(concat(lower(replace(p, ' ', '')), lower(s)))) AS t FROM t GROUP BY k) "
    "SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS shared FROM x a JOIN x b ON a.id < b.id AND len(list_intersect(a.t, b.t)) * 10 >= 9 * len(list_distinct(list_concat(a.t, b.t)))"
)
def similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact set-similarity join, on the status mix of customer groups."""
    status = F.concat(F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit(""))), F.lower("o_orderstatus"))
    sets = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("id")).agg(F.collect_set(status).alias("tokens"))
    pairs = dedup.similar_sets(sets)
    tokens = lambda c, t: sets.select(F.col("id").alias(c), F.col("tokens").alias(t))
    return pairs.join(tokens("a", "x"), "a").join(tokens("b", "y"), "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


@query(
    f"WITH d AS (SELECT doc_id, list_sort({o.fingerprint_tokens('text')}) AS t FROM documents WHERE doc_id IS NOT NULL), m AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS rep FROM d WHERE len(t) > 0), "
    "x AS (SELECT rep AS id, any_value(t) AS t, len(any_value(t)) AS n FROM m GROUP BY rep, t), "
    "p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS shared, a.n + b.n AS n FROM x a JOIN x b ON a.id < b.id AND least(a.n, b.n) * 10 >= 9 * greatest(a.n, b.n)) "
    "SELECT a, b, round(shared / (n - shared), 6) AS score FROM p WHERE shared * 10 >= 9 * (n - shared) UNION ALL SELECT DISTINCT rep, doc_id, 1.0::DOUBLE FROM m WHERE doc_id > rep"
)
def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact set-similarity join on the content tokens of all documents.

    Documents of one token set are a class, named by its least doc_id.  Rows of score 1 are the members (b) of
    classes (a); the others are the pairs of classes.  Two documents are similar if their classes are one or are paired, so all
    pairs follow from the rows, which don't grow with the square of a class.  Texts without tokens and rows
    without a doc_id match nothing.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    said = docs.select("doc_id", F.array_join(F.sort_array(content_tokens(F.col("text"))), " ").alias("said"))
    # written before anything is filtered, so that each text is read and cut into words once; no token holds a space
    prints = written(said.withColumn("print", F.unhex(F.sha2("said", 256)))).where("said <> ''")
    ids = prints.groupBy("print").agg(F.min("doc_id").alias("id"))
    members = prints.select("doc_id", "print").join(ids, "print").where("doc_id > id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("score")).distinct()
    sets = prints.groupBy("print").agg(F.min("doc_id").alias("id"), F.min("said").alias("said")).select("id", F.split("said", " ").alias("tokens"))
    return dedup.similar_sets(sets, separator=" ").select("a", "b", F.round("score", 6).alias("score")).unionByName(members)


_PAID = f"{ORACLE_JOBS.rstrip()}, {o.salary('jobs_v')}, amounts AS (SELECT seq, coalesce(currency, '?') AS currency, coalesce(period, 'year') AS period, (min_amount + coalesce(nullif(max_amount, 0), min_amount)) / 2 AS amount FROM paid WHERE min_amount IS NOT NULL)\n"


@query(_PAID + "SELECT currency, period, count(*) AS count, min(amount) AS min, max(amount) AS max, round(avg(amount), 2) AS avg, round(median(amount), 2) AS median FROM amounts GROUP BY 1, 2")
def salary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.salary_stats(jobs(spark, sf_dir))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def hiring_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hiring_trend(jobs_v(spark, sf_dir))


_TOP = "GROUP BY 1 ORDER BY n DESC, min(seq), 1 LIMIT"


@query(ORACLE_JOBS + f"SELECT coalesce(a.canonical, company) AS key, count(*) AS n FROM jobs_v LEFT JOIN {_ALIAS} ON lower(trim(company)) = a.alias {_TOP} 10")
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_counts(jobs(spark, sf_dir), F.coalesce("canonical_company_name", "company_name"), 10)


@query(o.JOBS + f"SELECT normalized_role AS key, count(*) AS n FROM jobs {_TOP} 10")
def top_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_counts(jobs(spark, sf_dir), F.coalesce("normalized_role", "role"), 10)


@query(o.JOBS + f"SELECT coalesce(city, country, CASE WHEN is_remote THEN 'Remote' END, 'Unknown') AS key, count(*) AS n FROM jobs {_TOP} 10")
def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_counts(jobs(spark, sf_dir), analytics.place_name(), 10)


@query(o.JOBS + f", t AS (SELECT employment_type AS key, count(*) AS n FROM jobs {_TOP} 10) SELECT key, n, round(n * 100 / max(n) OVER (), 1) AS pct FROM t ORDER BY n DESC, key LIMIT 8")
def employment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.bars(analytics.top_counts(jobs(spark, sf_dir), F.col("employment_type"), 10))


@query("SELECT count(*) AS new_today FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-08-02'")
def new_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.new_today(jobs_v(spark, sf_dir), F.lit("1998-08-02 07:00:00").cast("timestamp"))


#: The composite score without a vector: similarity 0, priority 0.5; parts in exact decimals.
_RANKED = (
    _SKILLS.rstrip()
    + ", "
    + o.JOBS[len(ORACLE_JOBS) :].lstrip(", \n").rstrip()
    + ", "
    + o.salary("jobs")
    + f""", matched AS (
  SELECT seq, listed, list_filter(listed, lambda s: list_contains(technical, s)) AS needed, list_filter(listed, lambda s: list_contains(technical, s) AND lower(s) IN ({", ".join(q(s.lower()) for s in RESUME.skills)})) AS met FROM skilled
), parts AS (
  SELECT j.seq, j.title, CAST(CASE WHEN len(needed) > 0 THEN round(len(met) / len(needed), 4) ELSE 0.5 END AS DECIMAL(9, 4)) AS skill,
    CASE WHEN min_years IS NULL THEN 0.7 WHEN min_years <= 2 THEN 1.0 ELSE greatest(0, 1 - (CAST(min_years AS DECIMAL(9, 3)) - 2) * 0.2) END AS experience,
    CASE WHEN is_remote THEN 1.0 WHEN lower(city) = 'bangalore' OR country = 'IN' THEN 1.0 ELSE 0.2 END AS place,
    8 - (CASE WHEN description IS NULL THEN 1 ELSE 0 END) - (CASE WHEN city IS NULL AND country IS NULL AND NOT is_remote THEN 1 ELSE 0 END)
      - (CASE WHEN min_amount IS NULL THEN 1 ELSE 0 END) - (CASE WHEN len(listed) = 0 THEN 1 ELSE 0 END) AS present,
    (CASE WHEN city IS NULL AND country IS NULL AND NOT is_remote THEN 10 ELSE 0 END) + (CASE WHEN employment_type = 'unknown' THEN 5 ELSE 0 END) + (CASE WHEN level = 'unknown' THEN 5 ELSE 0 END) + (CASE WHEN len(listed) = 0 THEN 10 ELSE 0 END) AS lost
  FROM paid j JOIN matched s USING (seq)
)
"""
)


@query(_RANKED + "SELECT seq, CAST(round(skill * 1000) AS BIGINT) AS skill, CAST(round(experience * 1000) AS BIGINT) AS experience, CAST(place * 1000 AS BIGINT) AS location, CAST(present * 125 AS BIGINT) AS completeness, CAST(100 - lost AS BIGINT) AS normalization FROM parts")
def rank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the composite score, in thousandths (hundredths for normalisation)."""
    ranked = rank(jobs(spark, sf_dir), RESUME, now())
    k = lambda c, n=1000: F.round(F.col(c) * n).cast("long")
    return ranked.select("seq", k("match.skill").alias("skill"), k("match.experience").alias("experience"), k("match.location").alias("location"), k("quality.completeness").alias("completeness"), k("quality.normalization", 100).alias("normalization"))


_SCORE = "round(24 * skill + 14 * experience + 10 * place + 10 * 0.5 + 5 * (0.20 + 0.25 * (1 - lost * 0.01) + 0.15 + 0.15 + 0.03125 * present), 2)"


@query(_RANKED.rstrip() + f", s AS (SELECT seq, title, CAST({_SCORE} AS DOUBLE) AS score FROM parts) SELECT seq, title, CAST(floor(score) AS BIGINT) AS points FROM s ORDER BY round(score, 1) DESC, seq LIMIT 50")
def top_matches_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifty; the freshness part is nil at this date, scores are compared to one place."""
    far = F.lit("2020-01-01 00:00:00").cast("timestamp")
    ranked = rank(jobs(spark, sf_dir), RESUME, far)
    return ranked.orderBy(F.desc(F.round("match.score", 1)), "seq").limit(50).select("seq", F.col("role").alias("title"), F.floor("match.score").cast("long").alias("points"))


@query(_RANKED.rstrip() + f", s AS (SELECT CAST({_SCORE} AS DOUBLE) AS score FROM parts) SELECT 'ai' AS resume_id, count(*) AS jobs, count(*) FILTER (score >= 89.995) AS b90, count(*) FILTER (score >= 74.995 AND score < 89.995) AS b75, count(*) FILTER (score >= 49.995 AND score < 74.995) AS b50, count(*) FILTER (score < 49.995) AS b0 FROM s")
def match_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = analytics.match_trend(scores(jobs(spark, sf_dir), RESUME, F.lit("2020-01-01 00:00:00").cast("timestamp")))
    at = lambda b: F.coalesce(F.col("histogram")[b], F.lit(0)).cast("long")
    return trend.select("resume_id", "jobs", at("90-100").alias("b90"), at("75-89").alias("b75"), at("50-74").alias("b50"), at("0-49").alias("b0"))


@query()
def rank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole match struct with hashed embeddings; tests hold it against a plain computation."""
    rows = jobs(spark, sf_dir)
    vector = [float(x) for x in Hasher().encode(["python pytorch rag machine learning engineer"])[0]]
    rows = rows.withColumn("similarity", text_cosine(job_text(rows), vector))
    return best_matches(rows, Resume("ai", vector, RESUME.skills, RESUME.preferred_locations), now(), 50).select("seq", "role", "match")


@query(o.JOBS + "SELECT seq, company AS company, title AS role, normalized_role, coalesce(city, country, CASE WHEN is_remote THEN 'Remote' END, '') AS location, work_mode, employment_type, min_years AS experience_min_years, level AS seniority, url AS apply_url FROM jobs")
def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.operators.exports import job_rows as rows

    flat = rows(jobs(spark, sf_dir))
    return flat.select("seq", "company", "role", "normalized_role", "location", "work_mode", "employment_type", "experience_min_years", "seniority", "apply_url")


@query()
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing embeddings of all documents; SQL has no such hash."""
    return table(spark, sf_dir, "documents").select("doc_id", hash_embedding(F.col("text")).alias("embedding"))


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 3 <> 0")
def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("job_hash"))
    return dedup.new_rows(rows, rows.where("seq % 3 = 0")).select("seq")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a fresh embedding; labels stand for the store, quality 0 for an old model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    model = F.when(F.col("quality") == 0, "old").otherwise("m1")
    stored = table(spark, sf_dir, "labels").select("doc_id", model.alias("model_name"), F.lit(1).alias("embedding_version")).join(docs, "doc_id")
    return store.stale(docs, stored, "doc_id", "m1", 1).select("doc_id")


@query(
    "SELECT o_orderkey AS job_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1 END AS created FROM orders WHERE o_orderkey % 4 <> 0 "
    "UNION ALL SELECT o_orderkey, 'new', 2 FROM orders WHERE o_orderkey % 4 = 0"
)
def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: keys that 4 doesn't divide; upserted: even keys.  created is the year of created_at less 2000."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_hash"))
    at = lambda y: F.lit(f"200{y}-01-01").cast("timestamp")
    stored = orders.where("job_hash % 4 <> 0").select("job_hash", F.lit("old").alias("status"), at(1).alias("created_at"), at(1).alias("updated_at"))
    done = store.upsert(stored, orders.where("job_hash % 2 = 0").select("job_hash", F.lit("new").alias("status")), ["job_hash"], at(2))
    return done.select("job_hash", "status", (F.year("created_at") - 2000).alias("created"))
