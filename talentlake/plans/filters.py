"""The filter chain as one CASE: the first failing filter is the recorded reason."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.parse import age_hours, min_years
from talentlake.functions.text import blank, whole_word

#: Title terms of senior roles.
SENIOR_TERMS = (
    "senior", "sr", "staff", "principal", "lead", "leads", "leader", "manager", "management", "director", "architect", "vp", "vice president",
    "head", "chief", "cto", "ceo", "coo", "cfo", "cio", "ciso", "cxo", "president", "engineering manager", "product manager", "program manager",
    "project manager", "delivery manager", "people manager", "team lead", "tech lead", "technical lead", "solution architect",
    "solutions architect", "enterprise architect", "distinguished", "fellow", "expert",
)
#: Level marks of mid bands and above.
LEVEL_MARKS = (
    r"(?i)\b(?:sde|swe|engineer|developer|dev|scientist|analyst|programmer|consultant)\s*[-–—]?\s*(?:[2-9]|ii|iii|iv|v|vi)\b"
    r"|\blevel\s*[2-9]\b|\bl[2-9]\b|\bs?mts\b|\bpmts\b|\b(?:ic|pl)[-\s]?[2-9]\b|\b[2-9]\s*/\s*[2-9]\b"
)
#: Phrases that ask for experience, and words of entry levels that outweigh them.
EXPERIENCED = r"\b(?:experienced professional|seasoned|veteran|extensive experience|highly experienced|proven track record|expert-level)\b"
ENTRY_WORDS = r"\b(?:fresher|freshers|graduate|new grad|campus|entry[- ]level|junior|jr\.?|associate|trainee|intern|internship|apprentice|early career|early talent)\b"
#: Title terms of the target profile, and of functions outside it.
TARGET_TERMS = (
    "ai engineer", "applied ai", "ai backend", "machine learning", "ml engineer", "mlops", "llm", "generative ai", "gen ai", "genai", "prompt engineer",
    "nlp", "natural language", "rag engineer", "computer vision", "deep learning", "ai/ml", "ai researcher", "research engineer",
    "data scientist", "data science", "data analyst", "data engineer", "analytics engineer", "decision scientist", "business intelligence",
    "bi analyst", "bi developer", "ml scientist", "backend engineer", "backend developer", "back end engineer", "python developer",
    "python engineer", "software engineer", "software developer", "sde", "full stack", "fullstack", "full-stack", "api engineer", "platform engineer",
    "application developer", "programmer analyst", "qa engineer", "qa automation", "quality engineer", "quality assurance",
    "automation test", "test engineer", "test automation", "sdet", "software test", "software development engineer in test",
)
EXCLUDED_TERMS = (
    "human resource", "hr business", "hr generalist", "recruit", "talent acquisition", "sourcer", "sales", "account executive", "account manager",
    "business development", "bdr", "sdr", "pre-sales", "presales", "solutions engineer", "solution engineer", "marketing", "seo", "content writer",
    "copywriter", "social media", "brand", "finance", "accountant", "accounting", "payroll", "tax", "audit", "legal", "counsel", "compliance",
    "procurement", "operations manager", "customer support", "customer success", "technical support", "help desk", "service desk",
    "benefits specialist", "administrative", "office manager", "graphic designer", "ux designer", "ui designer", "product designer",
    "product manager", "program manager", "project manager", "scrum master", "agile coach", "technical writer", "trainer", "teacher", "professor",
    "faculty", "nurse", "physician", "driver", "delivery", "warehouse", "field",
)

Filter = tuple[str, Column]


def title_text() -> Column:
    return F.lower(F.concat_ws(" ", blank(F.col("role")), blank(F.col("normalized_role"))))


def validated(raw: DataFrame) -> DataFrame:
    """Rows with an external id, a title and a URL."""
    return raw.where((blank(F.col("external_id")) != "") & (blank(F.col("title")) != "") & (blank(F.col("url")) != ""))


def seniority(max_years: float = 2.0, terms: Sequence[str] = SENIOR_TERMS) -> Filter:
    """Rejects senior levels, senior title terms and marks, and more required years than allowed."""
    title = title_text()
    text = F.concat_ws(" ", title, F.lower(F.substring(blank(F.col("description")), 1, 2000)))
    reject = (
        F.col("seniority").isin("mid", "senior", "lead")
        | title.rlike(whole_word(tuple(terms)))
        | title.rlike(LEVEL_MARKS)
        | (F.col("experience.min_years") > max_years)
        | (min_years(text) > max_years)
        | (text.rlike(EXPERIENCED) & ~title.rlike(ENTRY_WORDS))
    )
    return "seniority", F.coalesce(reject, F.lit(False))


def role_relevance(target: Sequence[str] = TARGET_TERMS, excluded: Sequence[str] = EXCLUDED_TERMS) -> Filter:
    """Rejects titles outside the target profile; exclusion counts first."""
    title = F.trim(title_text())
    return "role_relevance", (title == "") | title.rlike(whole_word(tuple(excluded))) | ~title.rlike(whole_word(tuple(target)))


def experience(max_years: float = 2.0, allow_entry: bool = True) -> Filter:
    entry = F.col("seniority").isin("fresher", "entry", "junior", "associate") if allow_entry else F.lit(False)
    return "experience", ~F.coalesce(entry, F.lit(False)) & F.coalesce(F.col("experience.min_years") > max_years, F.lit(False))


def freshness(now: Column, max_hours: float = 24.0) -> Filter:
    """Rejects postings older than allowed; an unknown date passes."""
    return "freshness", F.coalesce(age_hours(F.col("posted_date"), now) > max_hours, F.lit(False))


def location(allowed: Sequence[str] = (), allow_remote: bool = True) -> Filter:
    """Rejects places outside the allowed ones; none allowed means all."""
    if not allowed:
        return "location", F.lit(False)
    names = F.array(*[F.lit(a.lower()) for a in allowed])
    have = F.array_compact(F.transform(F.concat(F.array("location.city", "location.country"), F.col("location_tags")), lambda x: F.lower(x)))
    remote = (F.col("location.is_remote") if allow_remote else F.lit(False))
    return "location", ~(remote | F.arrays_overlap(have, names))


def default_chain(now: Column, max_years: float = 2.0, max_hours: float = 24.0, allowed: Sequence[str] = ()) -> list[Filter]:
    return [seniority(max_years), role_relevance(), experience(max_years), freshness(now, max_hours), location(allowed)]


def with_rejection(jobs: DataFrame, chain: Sequence[Filter]) -> DataFrame:
    """``jobs`` with rejected_by: the name of the first filter that fails, or null."""
    case = functools.reduce(lambda c, f: c.when(f[1], f[0]), chain[1:], F.when(chain[0][1], chain[0][0]))
    return jobs.withColumn("rejected_by", case)


def passed(jobs: DataFrame) -> DataFrame:
    return jobs.where("rejected_by IS NULL").drop("rejected_by")


def summary(jobs: DataFrame) -> DataFrame:
    """(rejected_by, n); passed rows count as "passed"."""
    return jobs.groupBy(F.coalesce("rejected_by", F.lit("passed")).alias("rejected_by")).agg(F.count("*").alias("n"))
