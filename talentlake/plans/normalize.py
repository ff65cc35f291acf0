"""Raw postings to the job schema, as one projection of native expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions import parse, terms
from talentlake.functions.text import blank, company_key, filled, fingerprint, job_key

SCHEMA_VERSION = 3
KEY_FIELDS = ("company_name", "role", "url", "description", "location", "posted_date", "salary", "skills")
#: Weights of the quality score.
QUALITY_WEIGHTS = {"parser": 0.20, "normalization": 0.25, "duplicate": 0.15, "collector": 0.15, "completeness": 0.25}


def payload_text(raw: Column, *keys: str) -> Column:
    """The first payload value, in order of keys, that is a string and not blank."""
    values = [F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in keys]
    return F.coalesce(*values)


def quality(parser: Column, normalization: Column, duplicate: Column, collector: Column) -> Column:
    """The quality struct; expects the job's columns beside it."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    present = {
        "location": F.col("location.city").isNotNull() | F.col("location.country").isNotNull() | F.col("location.is_remote"),
        "skills": F.size("skills") > 0,
        "posted_date": F.col("posted_date").isNotNull(),
        "salary": F.col("salary").isNotNull(),
    }
    missing = F.array_compact(F.array(*[F.when(~present[f] if f in present else blank(F.col(f)) == "", F.lit(f)) for f in KEY_FIELDS]))
    complete = 1.0 - F.size(missing) / float(len(KEY_FIELDS))
    part = {"parser": clamp(parser), "normalization": clamp(normalization), "duplicate": 1.0 - clamp(duplicate), "collector": clamp(collector), "completeness": complete}
    overall = sum((part[k] * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return F.struct(*[F.round(v, 4).alias(k) for k, v in part.items()], F.round(overall, 4).alias("overall"), missing.alias("missing_fields"))


def resolve_aliases(jobs: DataFrame, aliases: DataFrame | None, name: str = "company") -> DataFrame:
    """Adds canonical_company_name and company_slug from (alias, slug, canonical); unknown names get nulls.

    Of entries with the same alias the one of the largest ``ord`` counts.  The planner
    broadcasts the alias table where its size allows.
    """
    if aliases is None:
        return jobs.withColumns({"canonical_company_name": F.lit(None).cast("string"), "company_slug": F.lit(None).cast("string")})
    keyed = aliases.groupBy(company_key(F.col("alias")).alias("__alias")).agg(F.max_by(F.struct("slug", "canonical"), "ord").alias("__to"))
    joined = jobs.withColumn("__alias", company_key(F.col(name))).join(keyed, "__alias", "left")
    return joined.withColumns({"canonical_company_name": F.col("__to.canonical"), "company_slug": F.col("__to.slug")}).drop("__alias", "__to")


def normalize(
    raw: DataFrame,
    now: Column,
    aliases: DataFrame | None = None,
    roles: terms.Taxonomy = terms.ROLES,
    cities: terms.Taxonomy = terms.CITIES,
    skills: Mapping[str, terms.Taxonomy] = terms.SKILLS,
) -> DataFrame:
    """Jobs from raw postings: seq, external_id, title, company, location, description, url and optional columns.

    Optional columns are raw (a JSON text), posted_at or posted_date, source, source_type, ats_type, collector_version,
    career_url, parser_confidence and collector_confidence.  Nulls mean missing, never a rejection.
    """
    has = lambda c, kind="string", default=None: F.col(c).cast(kind) if c in raw.columns else F.lit(default).cast(kind)
    payload, description = has("raw"), F.col("description")
    typed = has("posted_at", "timestamp") if "posted_at" in raw.columns else has("posted_date", "timestamp")
    dated = parse.posted(payload_text(payload, "posted", "posted_date", "date", "published_at", "created_at", "updated_at"), now)
    kind = F.concat_ws(" ", F.coalesce(payload_text(payload, "employment_type", "type", "commitment"), F.col("title")), description)
    text = F.concat_ws(" ", filled(F.col("title")), filled(description))
    # what many patterns read is computed once, in a projection of its own; so is what several columns are made of
    place = F.nullif(F.trim("location"), F.lit(""))
    raw = raw.withColumns({"__low_title": F.lower(F.trim("title")), "__at": place, "__low_at": F.lower(place), "__low_text": F.lower(text)})
    found_in = lambda taxonomy: terms.first_found(F.col("__low_at"), taxonomy, lowered=True)
    parts = {"__city": found_in(cities), "__mode": found_in(terms.WORK_MODES), "__country": found_in(terms.COUNTRIES)}
    parts |= {f"__by_{k}": v for k, v in terms.skills_by_category(F.col("__low_text"), skills, lowered=True).items()}
    raw = raw.withColumns(parts)
    by_category, found, technical = terms.extract_skills({k: F.col(f"`__by_{k}`") for k in skills})
    jobs = raw.select(
        *[F.col(f"`{c}`") for c in raw.columns if c not in parts],
        parse.role(F.col("title"), roles, F.col("__low_title")).alias("__role"),
        parse.place_of(F.col("__at"), F.col("__city"), F.col("__mode"), F.col("__country")).alias("__place"),
        parse.salary(F.coalesce(payload_text(payload, "salary", "compensation", "pay"), description)).alias("salary"),
        parse.experience(F.coalesce(payload_text(payload, "experience", "experience_level"), description)).alias("experience"),
        parse.employment_type(kind).alias("employment_type"),
        F.coalesce(dated, typed).alias("__posted"),
        by_category.alias("skills_by_category"), found.alias("skills"), technical.alias("technologies"),
        fingerprint(F.col("title"), description).alias("content_fingerprint"),
    )
    jobs = resolve_aliases(jobs, aliases)
    where = F.concat_ws(" ", blank(F.col("__place.city")), blank(F.col("__place.country")))
    tags = parse.place_tags(F.col("__place"))
    jobs = jobs.select(
        "seq", F.lit(SCHEMA_VERSION).alias("schema_version"), "external_id",
        has("source", default="inline").alias("source"), has("source_type", default="ats").alias("source_type"), has("ats_type", default="unknown").alias("ats_type"),
        has("collector_version").alias("collector_version"), has("career_url").alias("career_url"),
        job_key(F.col("company"), F.coalesce("__role", "title"), where, F.col("url")).alias("job_hash"), "content_fingerprint",
        F.col("company").alias("company_name"), "canonical_company_name", "company_slug",
        F.when(F.col("canonical_company_name").isNotNull() & (F.col("canonical_company_name") != F.col("company")), F.array("company")).otherwise(F.array().cast("array<string>")).alias("company_aliases"),
        F.col("title").alias("role"), F.col("__role").alias("normalized_role"), "description", "url",
        F.col("__place").alias("location"), F.col("__place.country").alias("country"), F.col("__place.work_mode").alias("work_mode"),
        "salary", "employment_type", "experience", F.col("experience.level").alias("seniority"), tags.alias("location_tags"),
        F.array_distinct(F.concat(tags, F.when(F.col("employment_type") != "unknown", F.array("employment_type")).otherwise(F.array().cast("array<string>")))).alias("tags"),
        F.col("__posted").alias("posted_date"), "skills", "technologies", "skills_by_category",
        has("parser_confidence", "double", 1.0).alias("__parser"), has("collector_confidence", "double", 1.0).alias("__collector"),
        *[c for c in raw.columns if c in ("segment", "custkey", "totalprice", "embedding")],
    )
    no_place = F.col("location.city").isNull() & F.col("location.country").isNull() & ~F.col("location.is_remote")
    lost = (
        F.when(F.col("normalized_role").isNull(), 0.15).otherwise(0.0) + F.when(no_place, 0.10).otherwise(0.0)
        + F.when(F.col("employment_type") == "unknown", 0.05).otherwise(0.0) + F.when(F.col("seniority") == "unknown", 0.05).otherwise(0.0)
        + F.when(F.size("skills") == 0, 0.10).otherwise(0.0)
    )
    scored = jobs.withColumn("quality", quality(F.col("__parser"), F.greatest(F.lit(0.0), 1.0 - lost), F.lit(0.0), F.col("__collector")))
    return scored.withColumn("confidence_score", F.col("quality.overall")).drop("__parser", "__collector")


def job_text(jobs: DataFrame) -> Column:
    """Role, skills, technologies and description in one text, for embeddings."""
    return F.trim(F.concat_ws(" ", filled(F.col("role"), F.col("normalized_role")), F.array_join("skills", " "), F.array_join("technologies", " "), filled(F.col("description"))))
