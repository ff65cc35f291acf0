"""Company records: import columns, validation, aliases, classification, detection, routing and seeds."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.functions.text import blank, listed, seed_url_key, slug, truthy_flag

#: Accepted header spellings of company columns.
HEADERS = {
    "company": "name", "name": "name", "company_name": "name", "slug": "slug", "career_url": "career_url", "careerurl": "career_url",
    "career_page": "career_url", "careers": "career_url", "url": "career_url", "career_platform": "career_platform", "platform": "career_platform",
    "ats": "ats_type", "ats_type": "ats_type", "ats_platform": "ats_type", "ats_token": "ats_token", "board_token": "ats_token", "token": "ats_token",
    "industry": "industry", "headquarters": "headquarters", "hq": "headquarters", "country": "country", "company_category": "company_category",
    "category": "company_category", "hiring_category": "hiring_category", "priority_score": "priority_score", "priority": "priority_score",
    "ai_hiring_score": "ai_hiring_score", "remote_support": "remote_support", "remote": "remote_support", "active_status": "active_status",
    "active": "active_status", "crawl_frequency": "crawl_frequency", "frequency": "crawl_frequency", "supported_roles": "supported_roles",
    "roles": "supported_roles", "preferred_technologies": "preferred_technologies", "technologies": "preferred_technologies",
    "tech_stack": "preferred_technologies", "aliases": "aliases", "notes": "notes",
}
LISTS = ("supported_roles", "preferred_technologies", "aliases")
FLAGS = ("remote_support", "active_status")
#: Allowed values of enumerated columns.
ATS_TYPES = ("greenhouse", "lever", "ashby", "workday", "smartrecruiters", "bamboohr", "teamtailor", "recruitee", "jobvite", "icims", "oracle", "successfactors", "comeet", "breezyhr", "jazzhr", "unknown")
HIRING_CATEGORIES = ("aggressive", "active", "moderate", "occasional", "unknown")
COMPANY_CATEGORIES = (
    "it_services", "product", "startup", "unicorn", "saas", "fintech", "edtech", "healthtech", "ecommerce", "analytics_ai", "consulting",
    "bfsi", "manufacturing", "automotive", "telecom", "energy", "retail", "pharma", "conglomerate", "other", "unknown",
)
CRAWL_FREQUENCIES = ("daily", "twice_daily", "weekly", "biweekly", "monthly", "manual")


def canonical_columns(raw: DataFrame) -> DataFrame:
    """Raw text columns under their canonical names, trimmed, blank as null, lists and flags read; others are dropped.

    Of several columns with the same canonical name the last that is filled counts.
    """
    sources: dict[str, list[str]] = {}
    for c in raw.columns:
        name = HEADERS.get(c.strip().lower().replace(" ", "_"))
        if name:
            sources.setdefault(name, []).append(c)
    out = [c for c in ("row_no",) if c in raw.columns]
    for name, cols in sources.items():
        value = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in reversed(cols)])
        if name in LISTS:
            value = F.when(F.size(listed(value)) > 0, listed(value))
        elif name in FLAGS:
            value = truthy_flag(value)
        out.append(value.alias(name))
    return raw.select(*out)


def _issue(bad: Column, code: str, field: str, severity: str = "error") -> Column:
    return F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def validate(rows: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (row_no and canonical columns) with issues, an array of (code, field, severity), and valid.

    Every occurrence after the first of a slug, career URL or token is a duplicate, whether the first is valid or
    not.  Values that only warn are set to null.  The first row of each value comes from an aggregate, so nulls and common
    values gather nowhere.  ``row_no`` must be unique.
    """
    have = set(rows.columns)
    for c in (c for c in ("slug", "career_url", "ats_token") if c in have):
        first = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__{c}")).agg(F.min("row_no").alias(f"__first_{c}"))
        # a null meets nothing, under a key of its own
        rows = rows.withColumn("__key", F.coalesce(c, F.concat(F.lit("\x00"), F.col("row_no").cast("string")))).join(first, F.col("__key") == F.col(f"__{c}"), "left").drop("__key", f"__{c}")
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    again = lambda c: F.coalesce(F.col("row_no") > F.col(f"__first_{c}"), F.lit(False)) if c in have else F.lit(False)
    not_in = lambda c, values: F.coalesce(~F.lower(col(c)).isin(*values), F.lit(False))
    issues = [
        _issue(blank(col("name")) == "", "missing_required_field", "name"),
        _issue(blank(col("slug")) == "", "missing_required_field", "slug"),
        _issue(F.coalesce(~col("career_url").rlike(r"^(?i)https?://[^/\s]*\.[^/\s]+"), F.lit(False)), "malformed_url", "career_url"),
        _issue(not_in("ats_type", ATS_TYPES), "invalid_ats_type", "ats_type"),
        _issue(not_in("hiring_category", HIRING_CATEGORIES), "invalid_hiring_category", "hiring_category", "warning"),
        _issue(not_in("company_category", COMPANY_CATEGORIES), "invalid_company_category", "company_category", "warning"),
        _issue(not_in("crawl_frequency", CRAWL_FREQUENCIES), "invalid_crawl_frequency", "crawl_frequency", "warning"),
    ]
    if countries is not None:
        issues.append(_issue(F.coalesce(~F.upper(col("country")).isin(*[c.upper() for c in countries]), F.lit(False)), "unsupported_country", "country"))
    issues += [_issue(again(c), code, c) for c, code in (("slug", "duplicate_slug"), ("career_url", "duplicate_career_url"), ("ats_token", "duplicate_board_token"))]
    checked = rows.withColumn("issues", F.array_compact(F.array(*issues))).drop("__first_slug", "__first_career_url", "__first_ats_token")
    checked = checked.withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))
    allowed = {"ats_type": ATS_TYPES, "hiring_category": HIRING_CATEGORIES, "company_category": COMPANY_CATEGORIES, "crawl_frequency": CRAWL_FREQUENCIES}
    return checked.withColumns({c: F.when(F.lower(c).isin(*v), F.lower(c)) for c, v in allowed.items() if c in have})


def import_stats(checked: DataFrame) -> DataFrame:
    duplicate = F.exists("issues", lambda i: i["code"].startswith("duplicate"))
    return checked.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(duplicate).alias("duplicates"))


def dead_letters(checked: DataFrame) -> DataFrame:
    """Invalid rows with their reasons in one text."""
    return checked.where(~F.col("valid")).withColumn("reason", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["field"])), "; "))


def import_plan(valid: DataFrame, stored: DataFrame, overwrite: bool = True) -> DataFrame:
    """``valid`` with action: insert, update, or skip where overwriting is off."""
    known = stored.select("slug", F.lit(True).alias("__known")).distinct()
    action = F.when(F.col("__known").isNull(), "insert").otherwise("update" if overwrite else "skip")
    return valid.join(known, "slug", "left").withColumn("action", action).drop("__known")


#: Buckets and tiers of company categories.
BUCKETS = {
    "ai_genai": "Indian AI Company", "analytics_ai": "Indian AI Company", "saas": "Indian SaaS / Product", "product": "Indian Product Company",
    "unicorn": "Indian Unicorn", "fintech": "Indian FinTech (Startup)", "bfsi": "BFSI", "healthtech": "Healthcare / HealthTech", "pharma": "Pharma",
    "gcc": "GCC / Global Product (India)", "it_services": "Indian MNC / IT Services", "consulting": "Consulting", "startup": "Indian Startup",
    "deeptech": "Indian Startup (DeepTech)", "ecommerce": "Consumer / E-commerce", "consumer": "Consumer / E-commerce", "retail": "Consumer / E-commerce",
    "foodtech": "Consumer / E-commerce", "edtech": "EdTech", "gaming": "Gaming", "telecom": "Telecom", "energy": "Energy", "automotive": "Automotive",
    "manufacturing": "Manufacturing", "conglomerate": "Conglomerate", "aerospace": "Aerospace", "mobility": "Mobility", "travel": "Travel",
    "agritech": "AgriTech", "robotics": "Robotics", "spacetech": "SpaceTech", "proptech": "PropTech", "hrtech": "HRTech",
}
TIERS = {1: ("ai_genai", "saas", "product", "unicorn"), 2: ("analytics_ai", "fintech", "healthtech", "startup", "deeptech"), 3: ("gcc",), 4: ("it_services", "consulting")}
TIER_SCORES = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.4, 5: 0.2}


def bucket(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return F.coalesce(table[F.lower(category)], F.lit("Other (sector)"))


def tier(category: Column) -> Column:
    return functools.reduce(lambda c, kv: c.when(F.lower(category).isin(*kv[1]), kv[0]), list(TIERS.items())[1:], F.when(F.lower(category).isin(*TIERS[1]), 1)).otherwise(5)


def priority(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TIER_SCORES.items() for x in kv])[tier(category)]


#: Hosts of known platforms: marker, type, name, and where the board's token stands.
PLATFORMS = (
    ("greenhouse.io", "greenhouse", "Greenhouse", "path"), ("lever.co", "lever", "Lever", "path"), ("ashbyhq.com", "ashby", "Ashby", "path"),
    ("myworkdayjobs.com", "workday", "Workday", "none"), ("myworkdaysite.com", "workday", "Workday", "none"),
    ("smartrecruiters.com", "smartrecruiters", "SmartRecruiters", "path"), ("bamboohr.com", "bamboohr", "BambooHR", "subdomain"),
    ("teamtailor.com", "teamtailor", "Teamtailor", "subdomain"), ("recruitee.com", "recruitee", "Recruitee", "subdomain"),
    ("jobvite.com", "jobvite", "Jobvite", "path"), ("icims.com", "icims", "iCIMS", "subdomain"), ("oraclecloud.com", "oracle", "Oracle Recruiting", "none"),
    ("taleo.net", "oracle", "Oracle Taleo", "none"), ("sapsf.com", "successfactors", "SAP SuccessFactors", "none"),
    ("sapsf.eu", "successfactors", "SAP SuccessFactors", "none"), ("successfactors.com", "successfactors", "SAP SuccessFactors", "none"),
    ("comeet.co", "comeet", "Comeet", "path"), ("comeet.com", "comeet", "Comeet", "path"), ("breezy.hr", "breezyhr", "BreezyHR", "subdomain"),
    ("applytojob.com", "jazzhr", "JazzHR", "subdomain"),
)
GENERIC = ("www", "careers", "career", "jobs", "job", "apply", "boards")


def detect_platform(url: Column) -> Column:
    """struct(ats_type, token, platform, confidence) of a career URL."""
    rest = F.regexp_replace(F.trim(blank(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    names = F.array(*map(F.lit, GENERIC))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    first = F.when((F.size(labels) >= 3) & ~F.array_contains(names, labels[0]), labels[0])
    segment = F.get(F.filter(F.split(path, "/"), lambda x: (x != "") & ~F.array_contains(names, F.lower(x))), F.lit(0))
    tokens = {"path": segment, "subdomain": first, "none": F.lit(None).cast("string")}

    def made(kind: str, platform: str, where: str) -> Column:
        token = tokens[where]
        sure = F.lit(0.95) if where == "none" else F.when(token.isNotNull(), 0.95).otherwise(0.6)
        return F.struct(F.lit(kind).alias("ats_type"), token.alias("token"), F.lit(platform).alias("platform"), sure.alias("confidence"))

    null = F.lit(None).cast("string")
    unknown = F.struct(F.lit("unknown").alias("ats_type"), null.alias("token"), null.alias("platform"), F.lit(0.0).alias("confidence"))
    case = None
    for marker, *rule in PLATFORMS:
        hit = F.contains(host, F.lit(marker))
        case = F.when(hit, made(*rule)) if case is None else case.when(hit, made(*rule))
    return case.otherwise(unknown)


def fill_platforms(companies: DataFrame, least: float = 0.9) -> DataFrame:
    """Fills ats_type, ats_token and career_platform of companies of unknown type whose URL tells them surely."""
    rows = companies.withColumn("__d", detect_platform(F.col("career_url")))
    change = (F.coalesce("ats_type", F.lit("unknown")) == "unknown") & F.col("career_url").isNotNull() & (F.col("__d.confidence") >= least)
    set_to = {"ats_type": "ats_type", "ats_token": "token", "career_platform": "platform"}
    return rows.withColumn("updated", change).withColumns({c: F.when(change, F.coalesce(f"__d.{d}", c)).otherwise(F.col(c)) for c, d in set_to.items()}).drop("__d")


#: What a seed record has where nothing is known.
SEED_DEFAULTS = {
    "country": "IN", "company_category": "unknown", "ats_type": "unknown", "crawl_frequency": "weekly", "active_status": True,
    "priority_score": 50, "ai_hiring_score": 50, "remote_support": False,
}


def enrich_seeds(records: DataFrame) -> DataFrame:
    """Seed records with defaults for what is missing or empty, and the platform that their URL tells; ats_detected says where it did.

    A detected platform's token and name fill what is empty.  Columns of SEED_DEFAULTS, ats_token, career_platform and lists that are missing are added.
    """
    have = dict(records.dtypes)
    value = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")) if have[c] == "string" else F.col(c), F.lit(v).cast(have[c])) if c in have else F.lit(v)
    rows = records.withColumns({c: value(c, v) for c, v in SEED_DEFAULTS.items()})
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) if c in have else F.array().cast("array<string>") for c in LISTS})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("ats_token", "career_platform") if c not in have})
    rows = rows.withColumn("__d", detect_platform(F.col("career_url")))
    found = (F.lower("ats_type") == "unknown") & (F.col("__d.ats_type") != "unknown")
    fill = lambda c, d: F.when(found, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__d.{d}"))).otherwise(F.col(c))
    rows = rows.withColumns({"ats_detected": found, "ats_token": fill("ats_token", "token"), "career_platform": fill("career_platform", "platform")})
    return rows.withColumn("ats_type", F.when(F.col("ats_detected"), F.col("__d.ats_type")).otherwise(F.col("ats_type"))).drop("__d")


def seed_stats(records: DataFrame) -> DataFrame:
    """One row of counts over enriched records (with from_seed): total, from_seed_only, from_metadata, ats_detected, with_known_ats, remote_supported."""
    from_seed = F.coalesce(F.col("from_seed"), F.lit(False))
    return records.agg(
        F.count("*").alias("total"), F.count_if(from_seed).alias("from_seed_only"), F.count_if(~from_seed).alias("from_metadata"), F.count_if("ats_detected").alias("ats_detected"),
        F.count_if(F.coalesce(F.col("ats_type"), F.lit("")) != "unknown").alias("with_known_ats"), F.count_if("remote_support").alias("remote_supported"),
    )


def seed_counts(records: DataFrame, by: str) -> DataFrame:
    """(value, n) of records by category or platform, most frequent first."""
    return records.groupBy(F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def import_history(checked: DataFrame, stored: DataFrame, source: str, checksum: str, now: Column) -> DataFrame:
    """One row on an import: source, checksum, counts of rows by outcome, and when."""
    stats = import_stats(checked)
    done = import_plan(checked.where("valid").select("slug"), stored).agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"))
    return stats.join(F.broadcast(done)).withColumns({"source": F.lit(source), "checksum": F.lit(checksum), "imported_at": now})  # one row each


def route(companies: DataFrame, sources: DataFrame, registered: Sequence[str], order: Sequence[str] = ("ats", "career_page"), career_collector: str = "career_page", require_registered: bool = True) -> DataFrame:
    """Routing decisions: routed, collector, strategy, collector_available and reason, the first strategy that works winning.

    ``sources`` (name, enabled) is the registry.
    """
    have = set(companies.columns)
    rows = companies
    candidates = {"ats": F.when(F.col("ats_type").isNotNull() & (F.col("ats_type") != "unknown"), F.col("ats_type")), "career_page": F.when(F.col("career_url").isNotNull(), F.lit(career_collector))}
    for s in order:
        on = sources.select(F.col("name").alias(f"__{s}"), F.col("enabled").alias(f"__{s}_on"))
        rows = rows.withColumn(f"__{s}", candidates[s]).join(on, f"__{s}", "left")
    names = F.array(*map(F.lit, registered)).cast("array<string>")
    working, reasons = {}, []
    for s in order:
        c, on, known = F.col(f"__{s}"), F.coalesce(f"__{s}_on", F.lit(False)), F.array_contains(names, F.col(f"__{s}"))
        working[s] = c.isNotNull() & on & (known if require_registered else F.lit(True))
        reasons.append(F.when(c.isNotNull() & ~on, F.concat(F.lit(f"{s}:'"), c, F.lit("' disabled/absent"))).when(c.isNotNull() & F.lit(require_registered) & ~known, F.concat(F.lit(f"{s}:'"), c, F.lit("' collector not registered"))))
    pick = lambda value: functools.reduce(lambda case, s: case.when(working[s], value(s)), order[1:], F.when(working[order[0]], value(order[0])))
    why = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    collector, strategy = pick(lambda s: F.col(f"__{s}")), pick(F.lit)
    reason = F.coalesce(F.concat(F.lit("matched "), strategy, F.lit(" collector '"), collector, F.lit("'")), F.nullif(why, F.lit("")), F.lit("no ATS and no career URL"))
    return rows.select(*sorted(have), collector.isNotNull().alias("routed"), collector.alias("collector"), strategy.alias("strategy"), F.coalesce(F.array_contains(names, collector), F.lit(False)).alias("collector_available"), reason.alias("reason"))


def routing_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("collector", F.lit("skipped")).alias("collector")).agg(F.count("*").alias("n"))


def work_list(decisions: DataFrame) -> DataFrame:
    """Routed companies as targets of their collector, one row each: collector, slug, name, board_token and career_url."""
    return decisions.where("routed").select("collector", "slug", "name", F.coalesce("ats_token", "slug").alias("board_token"), "career_url")


def merge_seeds(metadata: DataFrame, seeds: DataFrame) -> DataFrame:
    """Companies of both tables (seq, name, slug, career_url, priority_score), one per slug and per URL.

    Metadata wins over seeds and the earlier row over the later; a seed's URL fills a metadata record that has none;
    a record whose URL another slug owns is left out.
    """
    both = metadata.withColumn("__from", F.lit(0)).unionByName(seeds.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    both = both.withColumns({"slug": F.coalesce(F.nullif(F.col("slug"), F.lit("")), slug(F.col("name"))), "__url": F.nullif(seed_url_key(F.col("career_url")), F.lit(""))}).where("slug <> ''")
    order = W.partitionBy("slug").orderBy("__from", "seq")
    both = both.withColumns({"__k": F.row_number().over(order), "__fill": F.first("career_url", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    one = both.where("__k = 1").withColumn("career_url", F.coalesce("career_url", "__fill"))
    owner = one.where("__url IS NOT NULL").groupBy(F.col("__url").alias("__of")).agg(F.min_by("slug", F.struct("__from", "seq", "slug")).alias("__owner"))
    own_key = F.coalesce("__url", F.concat(F.lit("\x00"), F.col("slug")))  # records without a URL meet nothing, under a key of their own
    kept = one.withColumn("__key", own_key).join(owner, F.col("__key") == F.col("__of"), "left").where("__owner IS NULL OR __owner = slug")
    return kept.drop("__k", "__url", "__fill", "__from", "__key", "__of", "__owner").orderBy(F.desc(F.coalesce(F.col("priority_score").cast("double"), F.lit(0.0))), F.lower("name"), "slug")
