"""The whole run against its parts, stored reranks, source files and encoders."""

import json

import pytest
from pyspark.sql import functions as F

from talentlake.functions.vectors import Hasher, hash_embedding
from talentlake.operators import embeddings, rank, runs
from talentlake.operators.buckets import Buckets
from talentlake.plans import daily, dedup, filters
from talentlake.plans.normalize import normalize
from talentlake.sources import files, registry

STORED = "job_hash string, seq long, role string, score double, created_at timestamp, updated_at timestamp"


def raw(spark):
    titles = ["Data Engineer", "Backend Engineer", "Senior Data Engineer", "Recruiter", "ML Engineer", ""]
    rows = [(k, str(k) if k % 11 else "", titles[k % 6], ["Acme", "Globex"][k % 2], ["Pune", "Remote", None][k % 3], f"Python and Docker, team {k // 4}. {k // 7} dashboards", f"https://x.y/{k // 2}", "2024-05-01 00:00:00") for k in range(80)]
    return spark.createDataFrame(rows, "seq long, external_id string, title string, company string, location string, description string, url string, posted_date string")


def test_daily(spark, tmp_path):
    now = F.lit("2024-05-01 05:00:00").cast("timestamp")
    chain = filters.default_chain(now)
    resume = rank.Resume("r", [float(x) for x in Hasher(64).encode(["python docker"])[0]], ["Python"], ["Pune"])
    table = Buckets(spark, str(tmp_path / "jobs"), STORED, ["job_hash"], 4)
    done = daily.daily(raw(spark), now, resume, chain, table=table, incremental=True)
    jobs = filters.with_rejection(normalize(filters.validated(raw(spark)), now), chain)
    kept = filters.passed(jobs)
    verdicts = {r["seq"]: r["is_duplicate"] for r in dedup.deduplicate(kept).collect()}
    unique = {s for s, dup in verdicts.items() if not dup}
    assert done.counts == {"kept": len(verdicts), "unique": len(unique), "ranked": len(unique)} and 0 < len(unique) < len(verdicts) < 80
    embedded = kept.where(F.col("seq").isin(list(unique)))
    embedded = embedded.withColumn("embedding", hash_embedding(daily.job_text(embedded), 64))
    want = {r["seq"]: r["match"]["score"] for r in rank.rank(embedded, resume, now).collect()}
    assert {r["seq"]: r["match"]["score"] for r in done.ranked.collect()} == want == {r["seq"]: r["score"] for r in table.rows().collect()}
    again = daily.daily(raw(spark), now, resume, chain, table=table, incremental=True)
    assert again.counts["ranked"] == 0 and table.rows().count() == len(unique)


def test_rerank_into(spark, tmp_path):
    now = F.lit("2024-05-01 05:00:00").cast("timestamp")
    jobs = normalize(filters.validated(raw(spark)).where("seq < 12"), now)
    resume = rank.Resume("r", [float(x) for x in Hasher().encode(["python docker"])[0]], ["Python"], ["Pune"])
    ranked = rank.rerank_stored(jobs, resume, now)
    schema = ranked.drop("created_at", "updated_at").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", created_at timestamp, updated_at timestamp"
    table = Buckets(spark, str(tmp_path / "jobs"), ddl, ["seq"], 4)
    table.upsert(jobs.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in ("embedding", "match") if c not in jobs.columns}), now)
    want = {r["seq"]: r["match"]["score"] for r in ranked.collect()}
    got = rank.rerank_into(table, resume, F.lit("2024-05-02 05:00:00").cast("timestamp"), None)
    stored = {r["seq"]: (r["match"]["score"], len(r["embedding"]), r["created_at"].day, r["updated_at"].day) for r in table.rows().collect()}
    assert {r["seq"] for r in got.collect()} == set(want) == set(stored) and all(v[1:] == (384, 1, 2) for v in stored.values())
    assert {r["seq"]: r["match"]["score"] for r in got.collect()} == {k: v[0] for k, v in stored.items()}


def test_source_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.json").write_text(json.dumps({"x": {"priority": 3, "options": {"base": "u"}}, "y": None, "z": {"enabled": False}}))
    (tmp_path / "b.yaml").write_text("- {name: x, legal_mode: scrape}\n- {name: w, rate_limit_rps: 0.5}\n- {priority: 1}\n")
    (tmp_path / "c.yml").write_text("")
    (tmp_path / "d.json").write_text("3")
    a, b = registry.read_sources(spark, str(tmp_path / "a.json")), registry.read_sources(spark, str(tmp_path / "b.yaml"))
    plain = lambda df: {r["name"]: (r["enabled"], r["priority"], r["legal_mode"], r["rate_limit_rps"], r["options"]) for r in df.collect()}
    assert plain(a) == {"x": (True, 3, "api", 2.0, {"base": "u"}), "y": (True, 100, "api", 2.0, {}), "z": (False, 100, "api", 2.0, {})}
    assert plain(b) == {"x": (True, 100, "scrape", 2.0, {}), "w": (True, 100, "api", 0.5, {})}
    b.write.parquet(str(tmp_path / "t"))
    assert plain(registry.read_table(spark, str(tmp_path / "t"))) == plain(b) and plain(registry.overlaid(a, b))["x"] == plain(b)["x"]
    assert registry.read_sources(spark, str(tmp_path / "c.yml")).count() == 0
    with pytest.raises(Exception, match="map or a list"):
        registry.read_sources(spark, str(tmp_path / "d.json")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        registry.read_sources(spark, str(tmp_path / "none.json"))


def test_yaml_companies(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("acme: {name: Acme, size: 3}\nglobex: {name: Globex}\n")
    (tmp_path / "m.yaml").write_text("companies:\n- {name: A, tags: [x, y]}\n- 7\n- {name: B}\n")
    rows = files.read_companies(spark, str(tmp_path / "c.yaml"), ["slug", "name", "size"]).orderBy("row_no").collect()
    assert [(r["slug"], r["name"], r["size"]) for r in rows] == [("acme", "Acme", "3"), ("globex", "Globex", None)]
    assert [r["fields"]["name"] for r in files.read_metadata(spark, str(tmp_path / "m.yaml")).orderBy("row_no").collect()] == ["A", "B"]


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "some text")], "id int, text string")
    now = F.lit("2024-05-01").cast("timestamp")
    model = embeddings.MODELS["intfloat/e5-base-v2"]
    with pytest.raises(ValueError, match="needs an encoder"):
        embeddings.embed(rows, F.col("text"), model, now)
    done = embeddings.embed(rows, F.col("text"), model, now, encoder=lambda t: F.array(F.length(t).cast("float"))).first()
    assert done["embedding"] == [float(len("passage: some text"))] and done["embedding_meta"]["model_name"] == model.name


def test_latest_version(spark):
    rows = spark.createDataFrame([("a", "1.9"), ("a", "1.10"), ("a", "1.2.7"), ("b", "x"), ("b", None)], "source string, collector_version string")
    assert runs.versions(rows).first()["collector_versions"] == {"a": "1.10", "b": "x"}
