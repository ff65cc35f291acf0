"""Sources, embeddings, resumes, archives, settings and streams on small cases."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake import config
from talentlake.functions.vectors import Hasher, cosine, cosine_to
from talentlake.operators import analytics, companies, embeddings, exports, rank, runs, search
from talentlake.plans.normalize import job_text, normalize
from talentlake.sources import files
from talentlake.streaming import trends


def at(text):
    return F.lit(text).cast("timestamp")


def test_checksums_and_metadata(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "b.csv").write_bytes(b"\x00" * 70_000)
    got = {r["path"].rsplit("/", 1)[1]: r["checksum"] for r in files.checksums(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": hashlib.sha256(b"x,y\n1,2\n").hexdigest(), "b.csv": hashlib.sha256(b"\x00" * 70_000).hexdigest()}
    for text, names in (("- name: A\n- name: B\n", ["A", "B"]), ("companies:\n- name: C\n- 7\n", ["C"]), ("just text", []), ("a: 1", []), ("", [])):
        (tmp_path / "m.yaml").write_text(text)
        rows = files.columns_of(files.read_metadata(spark, str(tmp_path / "m.yaml")), ["name"]).orderBy("row_no").collect()
        assert [r["name"] for r in rows] == names
    assert files.read_metadata(spark, str(tmp_path / "none.yaml")).count() == 0


def test_collected_and_archive(spark, tmp_path):
    one = spark.createDataFrame([("1", "a")], "external_id string, title string")
    two = spark.createDataFrame([("2", "x")], "external_id string, raw string")
    both = files.collected({"lever": one, "ashby": two})
    assert {(r["collector"], r["external_id"], r["title"], r["raw"]) for r in both.collect()} == {("lever", "1", "a", None), ("ashby", "2", None, "x")}
    for day in ("2026-01-01", "2026-01-02"):
        files.archive(both.select("collector", "raw"), str(tmp_path / "raw"), at(day))
    kept = spark.read.parquet(str(tmp_path / "raw"))
    assert kept.count() == 4 and {str(r["day"]) for r in kept.where("collector = 'ashby'").collect()} == {"2026-01-01", "2026-01-02"}
    assert kept.where("raw = 'x'").first()["digest"] == hashlib.sha256(b"x").hexdigest()


def test_seed_outputs(spark, tmp_path):
    import yaml

    rows = companies.enrich_seeds(spark.createDataFrame([("A", "https://boards.greenhouse.io/a1", None), ("É", None, ["x", "y"])], "name string, career_url string, aliases array<string>"))
    first = rows.where("name = 'A'").first()
    assert (first["ats_type"], first["ats_token"], first["priority_score"], first["aliases"], first["ats_detected"]) == ("greenhouse", "a1", 50, [], True)
    exports.write_seeds(rows, str(tmp_path))
    told = yaml.safe_load((tmp_path / "companies.yaml").read_text(encoding="utf-8"))["companies"]
    assert [x["name"] for x in told] == ["A", "É"] and told[1]["aliases"] == ["x", "y"]
    assert {r["aliases"] for r in spark.read.option("header", True).csv(str(tmp_path / "companies.csv")).collect()} == {None, "x;y"}
    assert spark.read.json(str(tmp_path / "companies.json")).count() == 2


def test_embed_only_what_changed(spark):
    model, text = embeddings.Model("m", 16), F.col("text")
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "id int, text string")
    done = embeddings.embed(rows, text, model, at("2026-01-01")).drop("renewed")
    want = Hasher(16).encode(["alpha beta", "gamma", None])
    assert all(np.allclose(r["embedding"], want[r["id"] - 1]) for r in done.collect())
    changed = done.withColumn("text", F.when(F.col("id") == 2, "delta").otherwise(text))
    again = {r["id"]: r for r in embeddings.embed(changed, text, model, at("2026-02-02")).collect()}
    assert [again[k]["renewed"] for k in (1, 2, 3)] == [False, True, False]
    assert again[1]["embedding_meta"]["generated_at"].month == 1 and again[2]["embedding_meta"]["generated_at"].month == 2 and np.allclose(again[2]["embedding"], Hasher(16).encode(["delta"])[0])
    moved = embeddings.migrate(done, text, embeddings.Model("n", 8), at("2026-03-03"))
    assert {(r["renewed"], len(r["embedding"]), r["embedding_meta"]["model_name"]) for r in moved.collect()} == {(True, 8, "n")}
    assert [tuple(r) for r in embeddings.from_models(done, embeddings.Model("n", 8)).collect()] == [("m", 3)]
    assert embeddings.embed(rows.limit(0), text, model, at("2026-01-01")).count() == 0


def test_resume_embeddings(spark):
    model = embeddings.Model("m", 16, query_prefix="query: ")
    cols = "resume_id string, content string, label string, skills array<string>, preferred_locations array<string>, max_experience_years double"
    first = embeddings.embed_resumes(spark.createDataFrame([("a", "one", "L", ["SQL"], ["Pune"], 1.0)], cols), spark.createDataFrame([], "resume_id string, label string, skills array<string>, preferred_locations array<string>, max_experience_years double, content_hash string, embedding array<float>, model_name string, embedding_version int, dimensions int, generated_at timestamp"), model, at("2026-01-01"))
    (row,) = first.collect()
    assert row["regenerated"] and np.allclose(row["embedding"], Hasher(16).encode(["query: one"])[0])
    stored = first.drop("regenerated")
    same, new = (embeddings.embed_resumes(spark.createDataFrame([("a", content, None, [], [], 5.0)], cols), stored, model, at("2026-02-02")).first() for content in ("one", "two"))
    assert (same["regenerated"], same["max_experience_years"], same["generated_at"].month) == (False, 1.0, 1)
    assert (new["regenerated"], new["label"], new["skills"], new["preferred_locations"], new["max_experience_years"]) == (True, "L", ["SQL"], ["Pune"], 5.0)


def test_cosine_to(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [3.0, 4.0]), (7, [1.0, None])], "id int, v array<double>")
    both = rows.select("id", cosine(F.array(F.lit(3.0), F.lit(4.0)), F.col("v")).alias("a"), cosine_to([3.0, 4.0], F.col("v")).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-12 for r in both) and {r["id"]: round(r["b"], 6) for r in both} == {1: 0.6, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}


def jobs_of(spark, *rows):
    made = [(k, str(k), title, "Acme", "Remote", text, f"https://x/{k}", "2026-06-01 11:00:00") for k, (title, text) in enumerate(rows)]
    return normalize(spark.createDataFrame(made, "seq long, external_id string, title string, company string, location string, description string, url string, posted_date string"), at("2026-06-01 12:00:00"))


def test_best_matches_are_those_of_the_whole_ranking(spark):
    rows = jobs_of(spark, *[("ML Engineer", f"Python {'and PyTorch ' * (k % 3)}{'Java ' * (k % 2)}, {k % 5} years") for k in range(40)])
    rows = rows.withColumn("embedding", F.array((F.col("seq") % 7).cast("double"), F.lit(1.0)))
    resume, now = rank.Resume("r", [1.0, 0.5], ["Python"]), at("2026-06-01 12:00:00")
    best = rank.best_matches(rows, resume, now, 9).collect()
    whole = rank.top_matches(rank.rank(rows, resume, now), 9).collect()
    assert [(r["seq"], r["match"]) for r in best] == [(r["seq"], r["match"]) for r in whole] and len(best) == 9


def test_rerank_stored(spark):
    rows = jobs_of(spark, ("Data Analyst", "SQL dashboards"), ("ML Engineer", "Python and PyTorch"), ("Gardener", "roses"))
    vector = [float(x) for x in Hasher().encode(["ML Engineer Python PyTorch"])[0]]
    stored = rows.withColumns({"match": F.lit("old"), "company_priority": F.lit(1.0)})
    got = rank.rerank_stored(stored.drop("company_priority"), rank.Resume("r", vector, ["Python", "PyTorch"]), at("2026-06-01 12:00:00")).collect()
    assert got[0]["role"] == "ML Engineer" and {r["match"]["company_priority"] for r in got} == {0.5}
    texts = {r["seq"]: r["t"] for r in rows.select("seq", job_text(rows).alias("t")).collect()}
    for r in got:
        assert abs(r["match"]["similarity"] - max(0.0, float(Hasher().encode([texts[r["seq"]]])[0] @ np.array(vector)))) < 1e-3
    assert len(rank.rerank_stored(rows, rank.Resume("r"), at("2026-06-01 12:00:00"), 2).collect()) == 2


def test_search_by_text(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["python engineer", "java engineer", "rose gardener", None])], "id int, text string")
    rows = rows.withColumn("embedding", embeddings.hash_embedding(F.col("text")))
    found = search.search(rows, "id", "python engineer", limit=2).collect()
    assert [r["id"] for r in found] == [0, 1] and found[0]["score"] == 1.0 and found[0]["text"] == "python engineer"
    assert [r["id"] for r in search.search(rows, "id", "rose gardener", hybrid=True, limit=1).collect()] == [2]


def test_record_runs(spark):
    none = spark.createDataFrame([], "collector string, runs long, total_jobs_found long, total_duplicates long, total_errors long, total_response_ms double, response_samples long, last_run_at timestamp")
    facts = spark.createDataFrame([("a", 5, 1, 0, 100.0, "2026-01-01"), ("a", None, 0, 2, None, "2026-01-03"), ("b", 1, 0, 0, 7.0, "2026-01-02")], "collector string, jobs_found long, duplicates long, errors long, response_ms double, run_at string").withColumn("run_at", F.col("run_at").cast("timestamp"))
    twice = {r["collector"]: r for r in analytics.record_runs(analytics.record_runs(none, facts), facts).collect()}
    assert tuple(twice["a"])[1:7] == (4, 10, 2, 4, 200.0, 2) and twice["a"]["last_run_at"].day == 3 and twice["b"]["runs"] == 2


def test_transitions_over_days(spark):
    events = [(1, "a", "2026-01-01 10:00", "syncing"), (2, "a", "2026-01-01 11:00", "failed"), (3, "a", "2026-01-04 00:00", "rate_limited"), (4, "a", "2026-01-04 00:00", "idle"), (5, "b", "2026-01-04 09:00", "failed"), (6, None, None, "disabled")]
    rows = spark.createDataFrame(events, "event_id int, collector string, at string, state string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["event_id"]: (r["before"], r["legal"]) for r in runs.transitions(rows).collect()}
    assert got == {1: ("idle", True), 2: ("syncing", True), 3: ("failed", False), 4: ("rate_limited", True), 5: ("idle", False), 6: ("idle", True)}


def test_validation_without_gathering_nulls(spark):
    rows = spark.createDataFrame([(k, "A", None if k % 2 else f"s{k % 4}", None, "t") for k in range(8)], "row_no long, name string, slug string, career_url string, ats_token string")
    got = {r["row_no"]: [i["code"] for i in r["issues"]] for r in companies.validate(rows).collect()}
    assert got[0] == [] and got[1] == ["missing_required_field", "duplicate_board_token"] and got[4] == ["duplicate_slug", "duplicate_board_token"] and len(got) == 8


def test_settings():
    env = {"TALENTLAKE_RANKING__TOP": "7", "talentlake_note": "plain", "OTHER_X": "1", "TALENTLAKE_FILTERS__ALLOWED_LOCATIONS": '["Pune"]'}
    got = config.load(environ=env, stored={"ranking": {"max_experience_years": 4.0}})
    assert got["ranking"] == {"top": 7, "max_experience_years": 4.0} and got["note"] == "plain" and got["filters"]["allowed_locations"] == ["Pune"] and "x" not in got
    assert config.load(environ={}) == config.DEFAULTS


def test_run_ids():
    one, two = runs.run_ids(), runs.run_ids("run_1")
    assert one["run_id"].startswith("run_") and one["correlation_id"].startswith("cor_") and one != runs.run_ids() and two["run_id"] == "run_1"


def test_streams_update_and_resume(spark, tmp_path):
    """Counts follow new files; keys that come again within the watermark stay one."""
    schema = "ts timestamp, job_hash string"
    source = tmp_path / "in"

    def put(name, rows):
        spark.createDataFrame(rows, "ts string, job_hash string").select(F.col("ts").cast("timestamp"), "job_hash").coalesce(1).write.mode("append").parquet(str(source))
        return name

    put("a", [("2026-01-01 01:00", "x"), ("2026-01-01 02:00", "y"), ("2026-01-02 02:00", "x")])
    read = lambda: spark.readStream.schema(schema).parquet(str(source))
    days = lambda: {str(r["day"]): r["n"] for r in trends.run_available(trends.daily_counts(read()), "t", ["day"], str(tmp_path / "out")).collect()}
    assert days() == {"2026-01-01": 2, "2026-01-02": 1}
    put("b", [("2026-01-02 05:00", "z")])
    assert days() == {"2026-01-01": 2, "2026-01-02": 2}


@pytest.mark.parametrize("kind", ["excel", "pdf"])
def test_optional_exports(spark, tmp_path, kind):
    data = exports.Report({}, {"t": spark.range(3)})
    try:
        exports.export(kind, data, str(tmp_path / "r"))
    except ImportError:
        pytest.skip("its library isn't installed")
    assert (tmp_path / "r").stat().st_size > 0


def test_report_is_json_whatever_its_rows(spark, tmp_path):
    exports.write_json(exports.Report({"a": 1}, {"none": spark.range(0), "odd": spark.createDataFrame([('"<&', None)], "x string, y int")}), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"meta": {"a": 1}, "none": [], "odd": [{"x": '"<&', "y": None}]}
