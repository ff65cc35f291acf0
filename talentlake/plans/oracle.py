"""DuckDB SQL of the row-wise operators, for oracle queries: written apart from the Column expressions.

Lookbehind isn't known there, so words are bounded by a character that is no letter, or an end.
"""

from __future__ import annotations

from talentlake.functions import parse, terms
from talentlake.plans import filters
from talentlake.plans.jobs_view import ORACLE_JOBS
from talentlake.plans.registry import sql_text as q


def find_first(x: str, taxonomy: terms.Taxonomy) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {q(s)}) THEN {q(c)}" for s, c in terms.synonyms(taxonomy)) + " END"


def words(terms_: tuple[str, ...]) -> str:
    import re

    return "(^|[^a-z])(" + "|".join(re.escape(t).replace("\\ ", " ") for t in terms_) + ")($|[^a-z])"


def role(x: str = "title") -> str:
    noise = "(?i)\\b(?:sr|senior|jr|junior|lead|staff|principal|intern|i{1,3}|iv|v)\\b"
    clean = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\(.*?\\)', ' ', 'g'), '{noise}', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce({find_first(x, terms.ROLES)}, {clean})"


def _years(x: str, pattern: str, k: int) -> str:
    return f"CAST(nullif(regexp_extract(lower(trim(coalesce({x}, ''))), {q(pattern)}, {k}), '') AS DOUBLE)"


def _level(x: str) -> str:
    return f"CASE WHEN {x} < 1 THEN 'entry' WHEN {x} < 3 THEN 'junior' WHEN {x} < 6 THEN 'mid' WHEN {x} < 9 THEN 'senior' ELSE 'lead' END"


def experience(x: str = "description") -> dict[str, str]:
    """min_years, max_years and level."""
    r, r2, p, s = _years(x, parse.YEARS_RANGE, 1), _years(x, parse.YEARS_RANGE, 2), _years(x, parse.YEARS_PLUS, 1), _years(x, parse.YEARS_SINGLE, 1)
    word = lambda value: " ".join(f"WHEN contains(lower(coalesce({x}, '')), {q(w)}) THEN {value(level, a, b)}" for w, level, a, b in parse.LEVEL_WORDS)
    case = lambda a, b, c, d, e: f"CASE WHEN {r} IS NOT NULL THEN {a} WHEN {p} IS NOT NULL THEN {b} WHEN {s} IS NOT NULL THEN {c} {word(d)} ELSE {e} END"
    return {
        "min_years": case(r, p, s, lambda level, a, b: f"CAST({a} AS DOUBLE)", "NULL"),
        "max_years": case(r2, "NULL", s, lambda level, a, b: f"CAST({b} AS DOUBLE)", "NULL"),
        "level": case(_level(r), _level(p), _level(s), lambda level, a, b: q(level), "'unknown'"),
    }


def employment(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {q(w)})' for w in ws)} THEN {q(kind)}" for kind, ws in parse.EMPLOYMENT) + " ELSE 'unknown' END"


def fingerprint_tokens(x: str) -> str:
    from talentlake.functions.text import STOPWORDS

    stop = ", ".join(map(q, STOPWORDS))
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w)))"


def fingerprint(x: str) -> str:
    tokens = fingerprint_tokens(x)
    return f"CASE WHEN len({tokens}) = 0 THEN '' ELSE sha256(array_to_string(list_sort({tokens}), ' ')) END"


def url_key(x: str) -> str:
    rest = f"regexp_replace(regexp_replace(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"
    host = f"regexp_replace(lower(regexp_extract({rest}, '^([^/;]*)', 1)), '^www\\.', '')"
    return f"concat({host}, lower(regexp_replace(regexp_replace({rest}, '^[^/;]*', ''), '/+$', '')))"


_E = experience()
#: jobs: jobs_v with the columns that filters, analytics and ranking read.
JOBS = (
    ORACLE_JOBS
    + f""", placed AS (
  SELECT *, {role()} AS normalized_role, {find_first("nullif(trim(location), '')", terms.CITIES)} AS found_city, {find_first("nullif(trim(location), '')", terms.COUNTRIES)} AS country,
    {find_first("nullif(trim(location), '')", terms.WORK_MODES)} AS mode FROM jobs_v
), jobs AS (
  SELECT *, CASE WHEN found_city <> 'Remote' THEN found_city END AS city, coalesce(mode, 'unknown') AS work_mode,
    (coalesce(mode, '') = 'remote' OR coalesce(found_city, '') = 'Remote') AS is_remote,
    {_E["min_years"]} AS min_years, {_E["max_years"]} AS max_years, {_E["level"]} AS level,
    {employment("concat_ws(' ', title, description)")} AS employment_type FROM placed
)
"""
)


def rejected_by(now: str, max_hours: float) -> str:
    title = "lower(concat(title, ' ', normalized_role))"
    text = f"concat({title}, ' ', lower(substring(coalesce(description, ''), 1, 2000)))"
    number = r"(\d+(?:\.\d+)?)"
    found = [parse.YEARS_RANGE, number + r"\s*\+\s*(?:years?|yrs?)", r"(?:minimum|min\.?|at least|atleast)\s*" + parse.YEARS_SINGLE]
    years = "list_min(list_transform(list_concat(" + ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in found) + "), lambda x: CAST(x AS DOUBLE)))"
    senior = (
        f"level IN ('mid', 'senior', 'lead') OR regexp_matches({title}, {q(words(filters.SENIOR_TERMS))}) OR regexp_matches({title}, {q(filters.LEVEL_MARKS)})"
        f" OR coalesce(min_years > 2, FALSE) OR coalesce({years} > 2, FALSE) OR (regexp_matches({text}, {q(filters.EXPERIENCED)}) AND NOT regexp_matches({title}, {q(filters.ENTRY_WORDS)}))"
    )
    off = f"regexp_matches({title}, {q(words(filters.EXCLUDED_TERMS))}) OR NOT regexp_matches({title}, {q(words(filters.TARGET_TERMS))})"
    late = f"epoch_us(TIMESTAMP '{now}') - epoch_us(posted_date) > {int(max_hours * 3_600_000_000)}"
    return f"CASE WHEN {senior} THEN 'seniority' WHEN {off} THEN 'role_relevance' WHEN {late} THEN 'freshness' END"


def skills(x: str, categories: tuple[str, ...]) -> str:
    """The skills of these categories in a text, category by category, long synonyms first: each synonym's pattern in order, the first of equals kept."""
    import re

    each = []
    for category in categories:
        for s, c in terms.synonyms(terms.SKILLS.get(category, {})):
            pattern = "(^|[^\\pL\\pN])" + re.escape(s).replace("\\ ", " ") + "($|[^\\pL\\pN])"
            each.append(f"CASE WHEN regexp_matches(lower({x}), {q(pattern)}) THEN {q(c)} END")
    listed = f"list_filter([{', '.join(each)}], lambda v: v IS NOT NULL)"
    return f"list_filter({listed}, lambda v, i: list_position({listed}, v) = i)"


ALL_SKILLS = tuple(c for c in terms.SKILLS if c not in terms.NO_SKILLS)


def salary(source: str, x: str = "description") -> str:
    """Common table expressions up to paid (the columns of ``source``, min_amount, max_amount, currency, period): the first figure with a sign of money."""
    groups = ", ".join(f"regexp_extract_all(trim(coalesce({x}, '')), {q(parse.SALARY)}, {k})" for k in range(1, 8))
    factor = lambda g: "CASE lower(z[%d]) WHEN 'crore' THEN 1e7 WHEN 'crores' THEN 1e7 WHEN 'cr' THEN 1e7 WHEN 'k' THEN 1e3 WHEN 'lpa' THEN 1e5 WHEN 'lakh' THEN 1e5 WHEN 'lakhs' THEN 1e5 WHEN 'lac' THEN 1e5 WHEN 'lacs' THEN 1e5 END" % g
    sign = "lower(coalesce(nullif(z[1], ''), nullif(z[4], '')))"
    return f"""money AS (SELECT *, list_filter(list_zip({groups}), lambda z: z[1] <> '' OR z[3] <> '' OR z[4] <> '' OR z[6] <> '' OR z[7] <> '')[1] AS z FROM {source}),
factors AS (SELECT *, {factor(3)} AS m1, {factor(6)} AS m2, {factor(7)} AS unit FROM money),
figures AS (SELECT *, coalesce(m1, m2, unit, 1.0) AS f1, coalesce(m2, m1, unit, 1.0) AS f2, CAST(nullif(replace(z[2], ',', ''), '') AS DOUBLE) AS n1, CAST(nullif(replace(z[5], ',', ''), '') AS DOUBLE) AS n2 FROM factors),
paid AS (SELECT * EXCLUDE (z, m1, m2, unit, f1, f2, n1, n2), CASE WHEN z IS NOT NULL THEN round(least(n1 * f1, n2 * f2), 2) END AS min_amount, CASE WHEN n2 IS NOT NULL THEN round(greatest(n1 * f1, n2 * f2), 2) END AS max_amount,
  CASE WHEN z IS NULL THEN NULL WHEN {sign} IN ('₹', 'rs', 'rs.', 'inr') THEN 'INR' WHEN {sign} IN ('$', 'usd') THEN 'USD' WHEN {sign} IN ('€', 'eur') THEN 'EUR' WHEN {sign} IN ('£', 'gbp') THEN 'GBP' WHEN greatest(f1, f2) >= 1e5 THEN 'INR' END AS currency,
  CASE WHEN z IS NULL THEN NULL WHEN z[7] = '' OR unit IS NOT NULL THEN 'year' WHEN contains(replace(lower(z[7]), ' ', ''), 'hour') THEN 'hour' WHEN contains(replace(lower(z[7]), ' ', ''), 'month') THEN 'month' ELSE 'year' END AS period FROM figures)"""
