"""Filters, ranking, stores, companies, sources, exports and runs on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from talentlake.operators import analytics, companies, exports, rank, runs, search, store
from talentlake.plans import filters
from talentlake.plans.normalize import normalize
from talentlake.sources import ats, files, registry


def raw(spark, *rows):
    return spark.createDataFrame([(k, str(k), *r) for k, r in enumerate(rows)], "seq long, external_id string, title string, company string, location string, description string, url string, posted_date string")


def job(title, description=None, location=None, posted="2026-06-01 11:00:00", company="Acme", url="https://x/1"):
    return (title, company, location, description, url, posted)


def now():
    return F.lit("2026-06-01 12:00:00").cast("timestamp")


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (job("Senior Data Scientist"), "seniority"), (job("Recruiter"), "role_relevance"), (job("Data Analyst"), None), (job("Backend Engineer II"), "seniority"),
        (job("Data Analyst", "Minimum 4 years of experience"), "seniority"), (job("Data Analyst", "a seasoned professional"), "seniority"),
        (job("Graduate Data Analyst", "a seasoned professional"), None), (job("Data Analyst", posted="2026-05-01 00:00:00"), "freshness"), (job("Data Analyst", posted=None), None),
        (job("ML Engineer IC3"), "seniority"), (job("Leadership Coach"), "role_relevance"), (job("Product Manager"), "seniority"),
    ],
)
def test_chain(spark, row, want):
    jobs = normalize(raw(spark, row), now())
    assert filters.with_rejection(jobs, filters.default_chain(now())).first()["rejected_by"] == want


def test_normalize_payload_and_nulls(spark):
    rows = raw(spark, job("Data Analyst", "text"), job(None, None, None, None, None, None)).withColumn("raw", F.when(F.col("seq") == 0, F.lit(json.dumps({"salary": "25-35 LPA", "posted": "yesterday", "type": "contract"}))))
    one, two = normalize(rows, now()).orderBy("seq").collect()
    assert (one["salary"]["min_amount"], one["employment_type"], one["posted_date"].isoformat()) == (2_500_000, "contract", "2026-05-31T12:00:00")
    assert two["normalized_role"] is None and two["quality"]["missing_fields"] == ["company_name", "role", "url", "description", "location", "posted_date", "salary", "skills"]


def test_rank_and_gap(spark):
    rows = raw(spark, job("ML Engineer", "Python and PyTorch, 0-1 years", "Remote"), job("Java Engineer", "Java, 4 years", "Berlin"))
    jobs = normalize(rows, now()).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    resume = rank.Resume("r", [1.0, 0.0], ["Python", "PyTorch"])
    one, two = rank.top_matches(rank.rank(jobs, resume, now()), 5).collect()
    assert one["role"] == "ML Engineer" and one["match"]["score"] > 85 and one["match"]["similarity"] == 1.0
    assert two["match"]["skill"] == 0.0 and two["match"]["experience"] < 1 and two["match"]["missing_skills"] == ["Java"]
    assert one["match"]["narrative"].startswith("Excellent match (")
    with pytest.raises(ValueError):
        rank.Resume(weights={"skill": 1.0})
    gap = rank.skill_gap(spark.createDataFrame([(["Docker", "Communication", "Python", "Go"], ["Docker", "Python", "Go", "SQL"])], "skills array<string>, technologies array<string>"), ["python"]).first()["gap"]
    assert gap["missing"] == ["Docker", "Go", "Communication"] and gap["coverage"] == 0.3333 and gap["learning_priority"][0]["priority"] == 1.0


def test_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1]), ("d", None)], "id string, embedding array<double>")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search.vector_search(rows, [1.0, 0.0], "id", 2)) == ["a", "c"]
    assert ids(search.vector_search(rows, [1.0, 0.0], "id", 5, threshold=0.5)) == ["a", "c"]
    assert ids(search.vector_search(rows, [1.0, 0.0], "id", 1, skip=1)) == ["c"]
    assert ids(search.vector_search(rows, [0.0, 0.0], "id", 2)) == []


def test_store(spark):
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    table = store.insert(old.limit(0).withColumns({"created_at": at(2020), "updated_at": at(2020)}), old, at(2021))
    done = store.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], at(2022))
    assert {(r["k"], r["v"], r["created_at"].year, r["updated_at"].year) for r in done.collect()} == {(1, "a", 2021, 2021), (2, "c", 2021, 2022), (3, "d", 2022, 2022)}
    assert {r["v"] for r in store.update(done, F.col("k") == 1, {"v": F.lit("z")}).collect()} == {"z", "c", "d"}
    assert store.delete(done, F.col("k") == 1).count() == 2
    assert store.insert_missing(old, spark.createDataFrame([(1, "x"), (9, "y")], "k int, v string"), ["k"]).count() == 3


def test_companies(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text("﻿company,slug,ats,ats_token,career_url,country,hiring category\nAcme,acme,Lever,t1,https://a.com,IN,wild\n,acme,bogus,t1,nope,IN,\nBeta,,greenhouse,t2,https://a.com,ZZ,active\n", encoding="utf-8")
    rows = companies.validate(companies.canonical_columns(files.read_companies(spark, str(csv), [])), ["IN"]).orderBy("row_no").collect()
    codes = [[i["code"] for i in r["issues"]] for r in rows]
    assert codes[0] == ["invalid_hiring_category"] and rows[0]["valid"] and rows[0]["hiring_category"] is None and rows[0]["ats_type"] == "lever"
    assert codes[1] == ["missing_required_field", "malformed_url", "invalid_ats_type", "duplicate_slug", "duplicate_board_token"]
    assert codes[2] == ["missing_required_field", "unsupported_country", "duplicate_career_url"]


def test_company_json_shapes(spark, tmp_path):
    shapes = ([{"name": "A", "slug": "a"}], {"a": {"name": "A"}}, {"companies": [{"name": "A", "slug": "a"}]})
    for k, shape in enumerate(shapes):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(shape))
        assert [tuple(r) for r in files.read_companies(spark, str(path), ["name", "slug"]).select("name", "slug").collect()] == [("A", "a")]
    with pytest.raises(ValueError):
        files.read_companies(spark, "x.txt", [])


def test_seed_table(spark):
    lines = ["+---+---+", "Company  Careers", "| Acme | https://a.com/jobs. |", "Beta Ltd    note   https://b.com", "| acme | https://other.com |", "| | https://none.com |"]
    rows = files.seed_entries(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")).orderBy("seq").collect()
    assert [(r["name"], r["career_url"]) for r in rows] == [("Acme", "https://a.com/jobs"), ("Beta Ltd", "https://b.com")]


def test_merge_seeds(spark):
    cols = "seq long, name string, slug string, career_url string, priority_score double"
    meta = spark.createDataFrame([(0, "Acme", None, None, 0.5), (1, "Own", "own", "https://www.own.com/", 0.9), (2, "Twin", "twin", "http://own.com", 1.0)], cols)
    seed = spark.createDataFrame([(0, "Acme", None, "https://acme.com", None), (1, "Own Legal", None, "https://own.com", None), (2, "New", None, "https://new.com", None)], cols)
    assert [(r["slug"], r["career_url"]) for r in companies.merge_seeds(meta, seed).collect()] == [("own", "https://www.own.com/"), ("acme", "https://acme.com"), ("new", "https://new.com")]


@pytest.mark.parametrize(
    ("platform", "row", "want"),
    [
        ("greenhouse", {"id": 1, "title": "T", "absolute_url": "u", "location": {"name": "L"}, "content": "c", "updated_at": "2026-01-01T00:00:00Z"}, ("1", "T", "u", "L", "c")),
        ("lever", {"id": "x", "text": "T", "hostedUrl": "u", "categories": {"location": "L"}, "descriptionPlain": "", "description": "d", "createdAt": 1767225600000}, ("x", "T", "u", "L", "d")),
        ("smartrecruiters", {"id": "1", "name": "T", "ref": "u", "location": {"city": "A", "country": "de"}, "releasedDate": "2026-01-01T00:00:00Z"}, ("1", "T", "u", "A, de", None)),
        ("bamboohr", {"id": 3, "jobOpeningName": "T", "jobOpeningUrl": "u", "isRemote": True}, ("3", "T", "u", "Remote", None)),
        ("successfactors", {"jobReqId": "9", "externalTitle": "T", "postingUrl": "u", "location": "L", "jobDescription": "d", "postedDate": "/Date(1767225600000)/"}, ("9", "T", "u", "L", "d")),
    ],
)
def test_boards(spark, platform, row, want):
    landed = spark.createDataFrame([("Acme", json.dumps(row)), ("Acme", json.dumps({**row, "title": "", "text": "", "name": "", "jobOpeningName": "", "externalTitle": ""}))], "company string, raw string")
    (got,) = ats.raw_jobs(landed, platform).collect()
    assert (got["external_id"], got["title"], got["url"], got["location"], got["description"]) == want
    assert got["posted_at"] is None or got["posted_at"].year == 2026
    assert len(ats.BOARDS) == 15


def test_runs(spark):
    rates = analytics.collector_rates(spark.createDataFrame([("g", 10, 2, 0, 100, "2026-01-01"), ("g", 6, 1, 1, 200, "2026-01-02")], "collector string, jobs_found long, duplicates long, errors int, response_ms long, run_at string")).first()
    assert (rates["avg_response_ms"], rates["success_rate"], rates["error_rate"], rates["jobs_per_run"], rates["duplicate_rate"]) == (150.0, 0.5, 0.5, 8.0, 3 / 16)
    one = spark.range(1)
    assert one.select(runs.poll_interval(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0))).first()[0] == 3600
    assert one.select(runs.poll_interval(F.lit(1e6), F.lit(0.0), F.lit(5))).first()[0] == 300
    assert one.select(runs.version_at_least(F.lit("1.10"), F.lit("1.9")), runs.capable(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[:] == (True, False)


def test_registry_and_exports(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, priority int")
    assert {tuple(r) for r in registry.overlaid(a, spark.createDataFrame([("y", 9)], "name string, priority int")).collect()} == {("x", 1), ("y", 9)}
    jobs = normalize(raw(spark, job("Data Analyst", "Python, SQL", "Remote")), now())
    rows = exports.job_rows(jobs)
    assert tuple(rows.columns[1:]) == exports.COLUMNS and rows.first()["skills"] == "Python; SQL" and rows.first()["location"] == "Remote"
    exports.write_csv(rows, str(tmp_path / "csv"), "gzip")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    many = spark.range(300).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("key"))
    data = exports.report(rows, {"top_skills": analytics.top_counts(jobs, F.col("skills"), 5, explode=True), "many": many}, {"version": 1})
    for fmt in ("json", "html"):
        exports.export(fmt, data, str(tmp_path / f"r.{fmt}"))
    page = (tmp_path / "r.html").read_text()
    assert "Python" in page and all(f"<td>m{k}</td>" in page for k in range(300))
    told = json.loads((tmp_path / "r.json").read_text())
    assert len(told["many"]) == 300 and told["jobs"][0]["skills"] == "Python; SQL" and told["meta"] == {"version": 1}
    assert list(exports.workbook(jobs, {"companies": many}, {}).tables) == ["Top Matches", "All Jobs", "Company Statistics"]
    with pytest.raises(ValueError):
        exports.export("x", data, "y")
    assert "a 1" in exports.prometheus({"a": 1})


def test_all_consecutive_vectors(spark, tmp_path):
    from talentlake.queries import QUERIES

    rows = [(k, [1.0, float(k % 2)]) for k in range(60) if k != 30]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["cosine_neighbours_all"](spark, str(tmp_path)).collect())
    assert got == [(k, k + 1, 0.707107) for k in range(59) if k not in (29, 30)]


def test_threshold_without_limit(spark, tmp_path):
    from talentlake.plans.other_queries import QUERY
    from talentlake.queries import QUERIES

    spark.range(1100).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, QUERY)).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["vector_threshold"](spark, str(tmp_path)).count() == 1100


def test_top_counts_leave_no_filter_below(spark):
    """An inner explode lets Spark repeat whatever the array is made of in a filter below all projections."""
    rows = spark.createDataFrame([(0, "python go"), (1, None), (2, "go java"), (3, "")], "seq long, low string").withColumn("by", F.transform(F.split("low", " "), lambda s: F.concat(s, F.lit("!"))))
    rows = rows.withColumn("by", F.filter("by", lambda s: s != "java!"))
    found = analytics.top_counts(rows, F.col("by"), 5, explode=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    assert [tuple(r) for r in found.collect()] == [("go!", 2), ("python!", 1), ("!", 1)]


def test_duplicate_members_make_rows_once(spark):
    jobs = normalize(raw(spark, job("Data Analyst", "sql"), job("Data Analyst", "sql"), job("Recruiter")), now())
    found = analytics.duplicate_members(jobs)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["seq"], r["first"], r["count"]) for r in found.collect()) == [(0, 0, 2), (1, 0, 2)]
