"""Queries over similar vectors, indexes, whole taxonomies and all resumes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions import terms
from talentlake.operators import ann, blocks, buckets, lexical, matching, search, selection, similarity
from talentlake.operators.shared import shared_dir
from talentlake.plans import dedup
from talentlake.plans import oracle as o
from talentlake.plans.job_queries import jobs
from talentlake.plans.jobs_view import table
from talentlake.plans.other_queries import QUERY
from talentlake.plans.registry import query
from talentlake.plans.registry import sql_text as q


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- vectors: the given ones, and two noisy copies of each, so that there are pairs on either side of the threshold

_COPIES = 10_000_000
_VECTORS = f"""WITH base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
vec AS (SELECT vec_id AS id, e AS v FROM base UNION ALL
  SELECT vec_id + k * {_COPIES}, list_transform(e, lambda x, i: x + 0.01::DOUBLE * (1 + vec_id % 6) * ((vec_id * 7 + (i - 1) * k * 3) % 5 - 2)) FROM base, (VALUES (1), (2)) n(k))
"""


def noisy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    noise = lambda k: F.transform("e", lambda x, i: x + F.lit(0.01) * (1 + F.col("vec_id") % 6) * ((F.col("vec_id") * 7 + i * k * 3) % 5 - 2))
    copies = [base.select((F.col("vec_id") + k * _COPIES).alias("id"), noise(k).alias("v")) for k in (1, 2)]
    return base.select(F.col("vec_id").alias("id"), F.col("e").alias("v")).unionByName(copies[0]).unionByName(copies[1])


@query(
    _VECTORS
    + """, c AS (SELECT v, min(id) AS cid, count(*) AS copies, list_dot_product(v, v) AS n FROM vec GROUP BY v),
p AS (SELECT a.cid, b.cid AS other, b.copies AS m, round(list_dot_product(a.v, b.v) / sqrt(a.n * b.n), 12) AS s FROM c a JOIN c b ON a.cid <> b.cid),
l AS (SELECT cid, sum(m) AS n, min({'o': -s, 'b': other}) AS best FROM p WHERE s >= 0.9 GROUP BY cid)
SELECT vec.id, c.cid AS class, c.copies, (coalesce(l.n, 0) + c.copies - 1)::BIGINT AS n_links, l.best.b AS best, round(-l.best.o, 6) AS best_score FROM vec JOIN c ON c.v = vec.v LEFT JOIN l ON l.cid = c.cid"""
)
def near_dup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact self-join of vectors at a cosine of 0.9 or more: for each vector its class, its number of links and the nearest class."""
    return similarity.cosine_links(noisy_vectors(spark, sf_dir), "id", "v").withColumn("best_score", F.round("best_score", 6))


@query()
def dedup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy dedup of postings of which three in four have a vector; not SQL, as acceptance depends on acceptance.  Tests replay it row by row."""
    vectors = noisy_vectors(spark, sf_dir).where(f"id < {2 * _COPIES}")
    n = table(spark, sf_dir, "embeddings").count()
    given = vectors.select(F.when(F.col("id") < _COPIES, F.col("id") * 2).otherwise((F.col("id") - _COPIES) * 2 + 1).alias("at"), F.col("v").alias("embedding"))
    rows = jobs(spark, sf_dir)
    at = F.when(F.col("seq") % 4 > 0, F.pmod(F.xxhash64("seq"), F.lit(2 * n)))
    return dedup.deduplicate(rows.withColumn("at", at).join(given, "at", "left").drop("at"))


_COS = lambda a, b: f"greatest(0, list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})))"


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("f"))
    return rows.where("id % 50 = 0"), rows


@query(
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS id, {_COS("a.e", "b.e")} AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INTEGER AS place, id, round(score, 6) AS score FROM s QUALIFY place <= 10"""
)
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all rows for every query (vec_id divisible by 50), exactly, by blocks."""
    queries, rows = _queries(spark, sf_dir)
    return blocks.best_of_each(queries, rows, 10).withColumn("score", F.round("score", 6))


@query()
def ann_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the inverted file, approximately; tests measure its recall against ``vector_neighbours``."""
    queries, rows = _queries(spark, sf_dir)
    index = ann.build(rows, "id", "f", _folder(spark, "ivf"), lists=32)
    return index.search_each(queries, 10).withColumn("score", F.round("score", 6))


_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"


@query(f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round({_COS('e', _Q)}, 6) AS score FROM v WHERE label = 2 ORDER BY {_COS('e', _Q)} DESC, vec_id LIMIT 10 OFFSET 5")
def index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an exact search over the inverted file; the condition reaches the scan."""
    index = ann.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _folder(spark, "ivf"), lists=32)
    return index.search(QUERY, 10, skip=5, where=F.col("label") == 2, exact=True).withColumn("score", F.round("score", 6))


# --- texts

_TEXT = "the erth of that reble with heing"


def _bm25(tokens: tuple[str, ...], limit: int) -> str:
    listed = ", ".join(map(q, tokens))
    return f"""d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents WHERE doc_id IS NOT NULL),
z AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d), t AS (SELECT id, len(w) AS length, unnest(w) AS token FROM d), tf AS (SELECT id, length, token, count(*) AS tf FROM t WHERE token IN ({listed}) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (token), z GROUP BY id ORDER BY round(score, 9) DESC, id LIMIT {limit})"""


_TOKENS = ("erth", "that", "reble", "heing")


def _postings(spark: SparkSession, sf_dir: str) -> lexical.Postings:
    index = lexical.Postings(spark, _folder(spark, "postings"), buckets=32)
    index.add(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["text"])
    return index


@query(f"WITH {_bm25(_TOKENS, 10)} SELECT id, round(score, 6) AS score FROM bm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(_TEXT, 10).withColumn("score", F.round("score", 6))


_SCALED = "CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s"


@query(
    f"""WITH {_bm25(_TOKENS, 20)}, e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), near AS (SELECT id, {_COS("v", _Q)} AS score FROM e ORDER BY score DESC, id LIMIT 20),
vs AS (SELECT id, {_SCALED} FROM near), ts AS (SELECT id, {_SCALED} FROM bm)
SELECT coalesce(vs.id, ts.id) AS id, round(0.6 * coalesce(vs.s, 0) + 0.4 * coalesce(ts.s, 0), 6) AS score FROM vs FULL JOIN ts ON vs.id = ts.id ORDER BY score DESC, id LIMIT 10"""
)
def hybrid_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of a vector leg and a BM25 leg."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return search.hybrid_search(vectors, QUERY, _TEXT, "id", ["text"], 10, postings=_postings(spark, sf_dir)).withColumn("score", F.round("score", 6))


#: The taxonomy: the 500 words of five letters or more that most documents hold, each under its first three letters.
_TAXONOMY = """w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
tops AS (SELECT s, count(*) AS n FROM (SELECT unnest(w) AS s FROM w) WHERE length(s) >= 5 GROUP BY s ORDER BY n DESC, s LIMIT 500), tax AS (SELECT 'x-' || substr(s, 1, 3) AS c, s FROM tops)"""


@query(
    f"""WITH {_TAXONOMY}, low AS (SELECT doc_id, lower(text) AS low FROM documents WHERE doc_id IS NOT NULL),
first AS (SELECT doc_id, min({{'l': -length(s), 'c': c, 's': s}}) AS b FROM low JOIN tax ON contains(low, s) GROUP BY doc_id),
held AS (SELECT doc_id, list_distinct(regexp_extract_all(low, '[\\pL\\pN]+')) AS t FROM low), every AS (SELECT doc_id, count(DISTINCT c) AS n, min({{'l': -length(s), 'c': c, 's': s}}) AS b FROM (SELECT doc_id, unnest(t) AS s FROM held) JOIN tax USING (s) GROUP BY doc_id)
SELECT low.doc_id, first.b.c AS first_found, coalesce(every.n, 0)::INTEGER AS n_found, every.b.c AS longest FROM low LEFT JOIN first USING (doc_id) LEFT JOIN every USING (doc_id)"""
)
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of synonyms over whole texts in one pass: the longest substring, and all whole tokens.  The taxonomy is a table that Spark derives."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    said = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("synonym")).where(F.length("synonym") >= 5)
    tops = said.groupBy("synonym").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "synonym").limit(500)
    taxonomy = terms.taxonomy_of(tops.select(F.concat(F.lit("x-"), F.substring("synonym", 1, 3)).alias("canonical"), "synonym"))
    found = docs.select("doc_id", terms.first_found(F.col("text"), taxonomy).alias("first_found"), terms.all_found(F.col("text"), taxonomy).alias("every"))
    return found.select("doc_id", "first_found", F.size("every").alias("n_found"), F.get("every", F.lit(0)).alias("longest"))


# --- all resumes against all jobs: customers are people, jobs and people share the vectors

_WISHES = {0: ["Bangalore"], 1: ["DE", "US"], 2: [], 3: ["Mumbai", "remote"], 4: ["Austin"]}
_KNOWN = {0: ["Python", "Docker", "SQL"], 1: ["java", "spring", "kubernetes"], 2: [], 3: ["Go", "AWS", "React", "MongoDB"], 4: ["PyTorch", "RAG", "python", "Azure"], 5: ["communication"]}


def _case(x: str, of: dict[int, list[str]], kind: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN {kind}({', '.join(map(q, v))})" for k, v in of.items() if v) + f" ELSE CAST({kind}() AS {'ARRAY<STRING>' if kind == 'array' else 'VARCHAR[]'}) END"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("resume_id"), F.expr(_case("c_custkey % 6", _KNOWN, "array")).alias("skills"), F.expr(_case("c_custkey % 5", _WISHES, "array")).alias("preferred_locations"),
        (F.col("c_custkey") % 4).cast("double").alias("max_experience_years"), (F.col("c_custkey") % n).alias("vec_id"),
    )
    return rows.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id", "left")


_FAR = "2020-01-01 00:00:00"
_TECH = f"{o.skills('''concat_ws(' ', title, description)''', terms.TECHNICAL)}"


@query(
    o.JOBS.rstrip()
    + f""", skilled AS (SELECT *, {o.skills("concat_ws(' ', title, description)", o.ALL_SKILLS)} AS listed, list_transform({_TECH}, lambda s: lower(s)) AS needed FROM jobs), {o.salary("skilled")},
job AS (SELECT seq, needed, min_years, is_remote, list_transform(list_filter([city, country], lambda x: x IS NOT NULL), lambda x: lower(x)) AS places, seq % (SELECT count(*) FROM embeddings) AS vec,
  round(0.2 * 1 + 0.25 * (1.0::DOUBLE - (CASE WHEN city IS NULL AND country IS NULL AND NOT is_remote THEN 10 ELSE 0 END + CASE WHEN employment_type = 'unknown' THEN 5 ELSE 0 END + CASE WHEN level = 'unknown' THEN 5 ELSE 0 END + CASE WHEN len(listed) = 0 THEN 10 ELSE 0 END) / 100.0) + 0.15 + 0.15
    + 0.25 * (8 - (CASE WHEN description IS NULL THEN 1 ELSE 0 END) - (CASE WHEN city IS NULL AND country IS NULL AND NOT is_remote THEN 1 ELSE 0 END) - (CASE WHEN min_amount IS NULL THEN 1 ELSE 0 END) - (CASE WHEN len(listed) = 0 THEN 1 ELSE 0 END)) / 8.0, 4) AS quality FROM paid),
person AS (SELECT c_custkey AS resume_id, c_custkey % 6 AS k, c_custkey % 5 AS w, c_custkey % 4 AS years, c_custkey % (SELECT count(*) FROM embeddings) AS vec FROM customer),
known AS (SELECT k, list_transform(s, lambda x: lower(x)) AS s FROM (SELECT k, {_case("k", _KNOWN, "list_value")} AS s FROM range(6) r(k))), wish AS (SELECT w, list_transform(p, lambda x: lower(x)) AS p FROM (SELECT w, {_case("w", _WISHES, "list_value")} AS p FROM range(5) r(w))),
skill AS (SELECT seq, k, CASE WHEN len(needed) > 0 THEN round(len(list_intersect(needed, s)) / len(needed), 4) ELSE 0.5 END AS skill FROM job, known),
spot AS (SELECT seq, w, CASE WHEN is_remote THEN 1.0 WHEN len(p) = 0 THEN 0.6 WHEN list_has_any(places, p) THEN 1.0 ELSE 0.2 END AS place FROM job, wish),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), sim AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS("a.v", "b.v")} AS s FROM e a, e b),
scored AS (SELECT resume_id, seq, round(100.0 * (s * 0.34 + skill * 0.24 + CASE WHEN min_years IS NULL THEN 0.7 WHEN min_years <= years THEN 1.0 ELSE greatest(0, 1 - (min_years - years) / 5.0) END * 0.14 + place * 0.10 + 0.5 * 0.10 + quality * 0.05), 2) AS score
  FROM person JOIN sim ON sim.a = person.vec JOIN job ON job.vec = sim.b JOIN skill USING (seq, k) JOIN spot USING (seq, w))
SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, seq)::INTEGER AS place, seq, score::DOUBLE AS score FROM scored QUALIFY place <= 10"""
)
def match_all_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best jobs of every customer by the composite score; postings are old, so the freshness part is nil."""
    n = table(spark, sf_dir, "embeddings").count()
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = jobs(spark, sf_dir).withColumn("at", F.col("seq") % n).join(vectors, "at", "left")
    return matching.match_all(rows, people(spark, sf_dir), F.lit(_FAR).cast("timestamp"), 10)


# --- positions, deep pages and stored buckets

_ORDERED = "row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1"


def _ranked(spark: SparkSession, sf_dir: str) -> selection.Ranked:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]]
    return selection.Ranked.build(lines, order, _folder(spark, "ranked"))


@query(f"SELECT l_orderkey, l_linenumber, {_ORDERED} AS position FROM lineitem")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every row by price, without a window over all rows."""
    return _ranked(spark, sf_dir).rows().select("l_orderkey", "l_linenumber", "position")


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_ORDERED} AS position, count(*) OVER () AS n FROM lineitem) SELECT l_orderkey, l_linenumber, position FROM r WHERE position >= 5 * n // 6 AND position < 5 * n // 6 + 25")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 25 rows at five sixths of the table; it reads one or two ranges."""
    ranked = _ranked(spark, sf_dir)
    return ranked.page(5 * ranked.total // 6, 25).select("l_orderkey", "l_linenumber", "position")


@query(
    """SELECT o_orderkey AS job_hash, CASE WHEN o_orderkey % 101 = 0 THEN 'new' WHEN o_orderkey % 103 = 0 THEN 'closed' ELSE 'old' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS created FROM orders WHERE (o_orderkey % 4 <> 0 OR o_orderkey % 101 = 0) AND o_orderkey % 107 <> 0"""
)
def bucketed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: keys that 4 doesn't divide; then upserts, changes and deletes of some keys, each of which rewrites the folders of these keys only."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_hash"))
    at = lambda y: F.lit(f"200{y}-01-01").cast("timestamp")
    stored = buckets.Buckets(spark, _folder(spark, "jobs"), "job_hash long, status string, created_at timestamp, updated_at timestamp", ["job_hash"], 32)
    stored.upsert(orders.where("job_hash % 4 <> 0").withColumn("status", F.lit("old")), at(1))
    stored.upsert(orders.where("job_hash % 101 = 0").withColumn("status", F.lit("new")), at(2))
    stored.update(orders.where("job_hash % 103 = 0 AND job_hash % 101 <> 0"), {"status": F.lit("closed")}, at(3))
    stored.delete(orders.where("job_hash % 107 = 0"))
    return stored.rows().select("job_hash", "status", (F.year("created_at") - 2000).alias("created"))
