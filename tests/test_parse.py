"""Parsers and keys, on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentlake.functions import parse, terms, text, vectors
from talentlake.operators.companies import detect_platform


def value(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("25-35 LPA", (2_500_000, 3_500_000, "INR", "year")), ("$120k - $150k per year", (120_000, 150_000, "USD", "year")), ("3+ years experience", None),
        ("1.2 crore CTC", (12_000_000, None, "INR", "year")), ("25000 per month", (25_000, None, None, "month")), ("", None), (None, None), ("£40 per hour", (40, None, "GBP", "hour")),
    ],
)
def test_salary(spark, said, want):
    got = value(spark, parse.salary(F.col("x")), x=said)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("fresher", (0, 1, "fresher")), ("2-4 years", (2, 4, "junior")), ("3+ years", (3, None, "mid")), ("5 years experience", (5, 5, "mid")), ("", (None, None, "unknown")), (None, (None, None, "unknown")), ("10+ customers", (10, None, "lead")), ("Senior", (6, 10, "senior"))],
)
def test_experience(spark, said, want):
    assert tuple(value(spark, parse.experience(F.col("x")), x=said)) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("summer internship", "internship"), ("contract to hire", "contract"), ("graduate program", "graduate_program"), ("full time", "full_time"), (None, "unknown"), ("international", "internship")],
)
def test_employment(spark, said, want):
    assert value(spark, parse.employment_type(F.col("x")), x=said) == want


def test_role_and_place(spark):
    assert value(spark, parse.role(F.col("x")), x="Senior Machine Learning Engineer (NLP)") == "ML Engineer"
    assert value(spark, parse.role(F.col("x")), x="Senior ml-ops wizard (x)") == "Ml-Ops Wizard"
    assert value(spark, parse.role(F.col("x")), x=" ") is None
    assert value(spark, parse.place(F.col("x")), x="Bengaluru, India")[1:4] == ("Bangalore", None, "IN")
    remote = value(spark, parse.place(F.col("x")), x="Remote (WFH)")
    assert (remote["work_mode"], remote["is_remote"], remote["city"]) == ("remote", True, None)
    assert value(spark, parse.place(F.col("x")), x="Berlin")["country"] == "IN"  # a substring of the name
    assert value(spark, parse.place(F.col("x")), x=None)["is_remote"] is False


NOW = dt.datetime(2026, 6, 1, 12)


@pytest.mark.parametrize(
    ("said", "want"),
    [("today", NOW), ("Yesterday", NOW - dt.timedelta(days=1)), ("2 days ago", NOW - dt.timedelta(days=2)), ("3 weeks ago", NOW - dt.timedelta(days=21)), ("1735689600", dt.datetime(2025, 1, 1)), ("1735689600000", dt.datetime(2025, 1, 1)), ("garbage", None), ("1000000000000000000", None), ("2026-05-01T00:00:00Z", dt.datetime(2026, 5, 1)), ("2026-07", None), ("10:00", None), (None, None)],
)
def test_posted(spark, said, want):
    got = value(spark, F.unix_micros(parse.posted(F.col("x"), F.lit("2026-06-01 12:00:00").cast("timestamp"))), x=said)
    assert got == (None if want is None else int(want.replace(tzinfo=dt.UTC).timestamp() * 1_000_000))


def test_keys(spark):
    assert value(spark, text.url_key(F.col("x")), x="https://www.X.com/a/?utm=1#frag") == "x.com/a"
    assert value(spark, text.url_key(F.col("x")), x="x.com/A b/") == "x.com/a b"
    assert value(spark, text.fingerprint(F.col("a"), F.col("b")), a="A B C", b="") == ""
    assert value(spark, text.fingerprint(F.col("x")), x="big data tools") == value(spark, text.fingerprint(F.col("x")), x="tools for the big data")
    assert value(spark, text.slug(F.col("x")), x="  Crème & Söhne GmbH ") == "creme-and-sohne-gmbh"
    assert value(spark, text.truthy_flag(F.col("x")), x=" Yes") is True
    assert value(spark, text.listed(F.col("x")), x="a; b;;c") == ["a", "b", "c"]


def test_skills(spark):
    _, skills, technical = terms.extract_skills(terms.skills_by_category(F.col("x")))
    said = "Python, FastAPI on AWS with Docker and PyTorch; category B.Tech communication"
    assert set(value(spark, skills, x=said)) == {"Python", "FastAPI", "AWS", "Docker", "PyTorch", "Communication"}
    assert set(value(spark, technical, x=said)) == {"Python", "FastAPI", "AWS", "Docker", "PyTorch"}
    assert value(spark, terms.exact(F.col("x"), terms.ROLES), x=" SDE ") == "Software Engineer"
    assert value(spark, skills, x=None) == []


@pytest.mark.parametrize(
    ("url", "kind", "token"),
    [
        ("https://boards.greenhouse.io/acme", "greenhouse", "acme"), ("https://jobs.lever.co/acme/1", "lever", "acme"), ("https://jobs.ashbyhq.com/acme", "ashby", "acme"),
        ("https://acme.wd1.myworkdayjobs.com/x", "workday", None), ("https://acme.bamboohr.com/jobs", "bamboohr", "acme"), ("https://acme.recruitee.com", "recruitee", "acme"),
        ("https://breezy.hr", "breezyhr", None), ("https://example.com/careers", "unknown", None), (None, "unknown", None),
    ],
)
def test_platforms(spark, url, kind, token):
    got = value(spark, detect_platform(F.col("x")), x=url)
    assert (got["ats_type"], got["token"]) == (kind, token)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], ["a", "b"], ["b", "c"])], "a array<double>, b array<double>, s array<string>, t array<string>")
    row = df.select(vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.array().cast("array<double>")), vectors.jaccard(F.col("s"), F.col("t"))).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 1 / 3)
    import numpy as np

    v = vectors.Hasher().encode(["python data", "", None])
    assert np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any() and not v[2].any()


def test_long_searches_run_once(spark):
    """The patterns of experience stand in the plan a few times, not dozens."""
    rows = spark.createDataFrame([("3 - 5 years",), ("4+",), ("yr 2 yrs, senior",), ("seniority",), ("5+ exp 1 year",), (None,), ("2.5 to 4+ yrs",)], "t string")
    df = rows.select(parse.experience(F.col("t")).alias("e"))
    planned = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= planned(parse.experience(F.col("t"))).count("regexp_extract(") <= 8
    assert [tuple(r["e"]) for r in df.collect()] == [
        (3.0, 5.0, "mid"), (4.0, None, "mid"), (2.0, 2.0, "junior"), (6.0, 10.0, "senior"), (5.0, None, "mid"), (None, None, "unknown"), (2.5, 4.0, "junior"),
    ]


def test_embedding_of_long_texts_in_little_room():
    """A batch is encoded piece by piece: the tokens of all its texts aren't held at once."""
    import tracemalloc

    texts = [None, "", *(f"word{k} and go " * 2000 for k in range(200)), "end"]
    hasher = vectors.Hasher()
    whole = hasher.encode(texts, chars=10**12)
    tracemalloc.start()
    pieces = vectors.Hasher().encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (pieces == whole).all() and peak < 30e6
