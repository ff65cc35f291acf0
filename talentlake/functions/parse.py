"""Parsers of free text as Column expressions: experience, salary, employment type, role, place and dates."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentlake.functions.terms import CITIES, COUNTRIES, ROLES, WORK_MODES, Taxonomy, first_found
from talentlake.functions.text import blank, once, title_case

_NUMBER = r"(\d+(?:\.\d+)?)"
#: The patterns of required experience.
YEARS_RANGE = _NUMBER + r"\s*(?:-|to|–|—)\s*" + _NUMBER + r"\s*\+?\s*(?:years?|yrs?)"
YEARS_PLUS = _NUMBER + r"\s*\+\s*(?:years?|yrs?)?(?:\s*(?:of\s*)?exp\w*)?"
YEARS_SINGLE = _NUMBER + r"\s*(?:years?|yrs?)"
#: Words that name a level, in order of precedence, with the years they imply.
LEVEL_WORDS = (
    ("fresher", "fresher", 0.0, 1.0), ("graduate", "fresher", 0.0, 1.0), ("intern", "fresher", 0.0, 1.0), ("entry", "entry", 0.0, 1.0),
    ("junior", "junior", 1.0, 3.0), ("associate", "associate", 1.0, 3.0), ("mid", "mid", 3.0, 6.0), ("senior", "senior", 6.0, 10.0),
    ("staff", "lead", 8.0, 12.0), ("principal", "lead", 10.0, 15.0), ("lead", "lead", 8.0, 12.0),
)
#: Employment types by keyword, in order of precedence.
EMPLOYMENT = (
    ("graduate_program", ("graduate program", "graduate programme", "new grad")),
    ("apprenticeship", ("apprentice", "apprenticeship")),
    ("internship", ("intern", "internship", "trainee")),
    ("freelance", ("freelance", "freelancer")),
    ("contract", ("contract", "contractor", "c2h", "b2b")),
    ("temporary", ("temporary", "temp", "seasonal")),
    ("part_time", ("part time", "part-time", "parttime")),
    ("full_time", ("full time", "full-time", "fulltime", "permanent", "regular")),
)


def _case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return functools.reduce(lambda c, b: c.when(*b), branches[1:], F.when(*branches[0])).otherwise(otherwise)


#: Levels by years of experience.
def _level(years: Column) -> Column:
    return F.when(years < 1, "entry").when(years < 3, "junior").when(years < 6, "mid").when(years < 9, "senior").otherwise("lead")


def experience(text: Column) -> Column:
    """struct(min_years, max_years, level): a range, else "n+", else "n years", else a word that names a level."""
    made = lambda a, b, level: F.struct(a.cast("double").alias("min_years"), b.cast("double").alias("max_years"), level.alias("level"))
    none = F.lit(None).cast("double")

    def read(low: Column) -> Column:
        number = lambda pattern, k: F.regexp_extract(low, pattern, k).try_cast("double")
        # plain searches, which are cheap, come before the patterns that can't match without what they look for
        years = F.contains(low, F.lit("year")) | F.contains(low, F.lit("yr"))
        words = [(F.contains(low, F.lit(w)), made(F.lit(a), F.lit(b), F.lit(level))) for w, level, a, b in LEVEL_WORDS]
        word = _case(words, made(none, none, F.lit("unknown")))
        single = once(F.when(years, number(YEARS_SINGLE, 1)), lambda s: F.when(s.isNotNull(), made(s, s, _level(s))).otherwise(word))
        plus = once(F.when(F.contains(low, F.lit("+")), number(YEARS_PLUS, 1)), lambda p: F.when(p.isNotNull(), made(p, none, _level(p))).otherwise(single))
        return once(F.when(years, number(YEARS_RANGE, 1)), lambda r: F.when(r.isNotNull(), made(r, number(YEARS_RANGE, 2), _level(r))).otherwise(plus))

    return once(F.lower(F.trim(blank(text))), read)


def employment_type(text: Column) -> Column:
    low = F.lower(blank(text))
    return _case([(functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in words]), F.lit(kind)) for kind, words in EMPLOYMENT], F.lit("unknown"))


#: The parts of a salary figure.
_MAGNITUDE = "lpa|lakhs?|lacs?|crores?|cr|k"
_PERIOD = r"lpa|ctc|per\s*annum|p\.?a\.?|/\s*yr|/\s*year|annually|per\s*month|/\s*month|monthly|per\s*hour|/\s*hour|hourly"
SALARY = (
    r"(?i)(₹|rs\.?|inr|\$|usd|€|eur|£|gbp)?\s*(\d[\d,]*(?:\.\d+)?)\s*(" + _MAGNITUDE + r")?"
    r"(?:\s*(?:-|to|–|—)\s*(₹|\$|€|£)?\s*(\d[\d,]*(?:\.\d+)?)\s*(" + _MAGNITUDE + r")?)?\s*(" + _MAGNITUDE + "|" + _PERIOD + ")?"
)
_CODES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
_FACTORS = {"crore": 1e7, "crores": 1e7, "cr": 1e7, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "k": 1e3}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(key)]


def salary(text: Column) -> Column:
    """struct(min_amount, max_amount, currency, period) of the first figure with a sign of money; null without one."""
    raw = F.trim(blank(text))
    # the first match that has a currency, a magnitude or a unit counts: anything but figures and what joins them
    found = F.regexp_extract_all(raw, F.lit(SALARY), F.lit(0))
    money = F.get(F.filter(found, lambda m: F.regexp_replace(m, r"(?i)(?<=\d)\s*to\s*(?=\d)", " ").rlike(r"[^\d\s.,\-–—]")), F.lit(0))
    names = ("c1", "n1", "m1", "c2", "n2", "m2", "tail")
    # the pattern is matched once more for all of its groups, parted by a sign that no figure holds
    parts = F.transform(F.array_compact(F.array(money)), lambda m: F.split(F.regexp_replace(m, SALARY, "\u0001".join(f"${k}" for k in range(1, 8))), "\u0001"))
    hit = F.transform(parts, lambda x: F.struct(*[x[k].alias(n) for k, n in enumerate(names)]))

    def build(z: Column) -> Column:
        has = lambda c: F.nullif(z[c], F.lit(""))
        m1, m2, unit = (_lookup(_FACTORS, has(c)) for c in ("m1", "m2", "tail"))
        f1, f2 = F.coalesce(m1, m2, unit, F.lit(1.0)), F.coalesce(m2, m1, unit, F.lit(1.0))
        amount = lambda c: F.replace(has(c), F.lit(","), F.lit("")).cast("double")
        low, high = amount("n1") * f1, amount("n2") * f2
        tail = F.regexp_replace(F.lower(z["tail"]), " ", "")
        period = F.when((z["tail"] == "") | unit.isNotNull(), "year").when(F.contains(tail, F.lit("hour")), "hour").when(F.contains(tail, F.lit("month")), "month").otherwise("year")
        currency = F.coalesce(_lookup(_CODES, F.coalesce(has("c1"), has("c2"))), F.when(F.greatest(f1, f2) >= 1e5, F.lit("INR")))
        return F.struct(
            F.round(F.least(low, high), 2).alias("min_amount"),
            F.when(high.isNotNull(), F.round(F.greatest(low, high), 2)).alias("max_amount"),
            currency.alias("currency"),
            period.alias("period"),
        )

    return F.get(F.transform(hit, build), F.lit(0))


#: Words that say nothing about the role.
_NOISE = r"(?i)\b(?:sr|senior|jr|junior|lead|staff|principal|intern|i{1,3}|iv|v)\b"


def role(title: Column, roles: Taxonomy = ROLES, low: Column | None = None) -> Column:
    """The canonical role, or else the cleaned title in title case; null for a blank title.  ``low`` is the trimmed title in lower case, if it is at hand."""
    text = F.trim(title)
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", " "), _NOISE, " "), r"[^A-Za-z0-9/ +.\-]", " ")
    cleaned = F.trim(F.regexp_replace(cleaned, r"\s+", " "))
    return F.when(F.length(text) > 0, F.coalesce(first_found(F.lower(text) if low is None else low, roles, lowered=True), F.when(cleaned != "", title_case(cleaned)), text))


def place(raw: Column, cities: Taxonomy = CITIES, modes: Taxonomy = WORK_MODES, countries: Taxonomy = COUNTRIES) -> Column:
    """struct(raw, city, region, country, work_mode, is_remote) of a location text."""
    text = F.nullif(F.trim(raw), F.lit(""))
    return place_of(text, first_found(text, cities), first_found(text, modes), first_found(text, countries))


def place_of(text: Column, city: Column, mode: Column, country: Column) -> Column:
    """The struct of ``place`` from what was found in its text."""
    return F.struct(
        text.alias("raw"),
        F.when(city != "Remote", city).alias("city"),
        F.lit(None).cast("string").alias("region"),
        country.alias("country"),
        F.coalesce(mode, F.lit("unknown")).alias("work_mode"),
        (mode.eqNullSafe("remote") | city.eqNullSafe("Remote")).alias("is_remote"),
    )


def place_tags(p: Column) -> Column:
    return F.array_compact(F.array(F.when(p["is_remote"], F.lit("remote")), F.lower(p["city"]), F.lower(p["country"])))


_UNIT_SECONDS = {"hour": 3600, "hr": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
_AGO = r"(\d+)\s*(hour|hr|day|week|month|year)s?\s*ago"
_ISO = r"^\d{4}-?\d{2}-?\d{2}(?:[T ].*)?$"


def epoch(seconds: Column) -> Column:
    """A timestamp from seconds, or from milliseconds where the figure is above 1e12; null beyond the calendar."""
    s = F.when(seconds > 1e12, seconds / 1000.0).otherwise(seconds)
    return F.when((s > -62135596800) & (s < 253402300800), F.timestamp_micros((s * 1_000_000).cast("long")))


def posted(text: Column, now: Column) -> Column:
    """A posting's date from words ("yesterday", "3 weeks ago"), epoch digits or ISO 8601; null for all else."""
    raw = F.trim(text)
    low = F.lower(raw)
    units = F.create_map(*[F.lit(x) for kv in _UNIT_SECONDS.items() for x in kv])
    ago = F.regexp_extract(low, _AGO, 1).try_cast("long") * units[F.regexp_extract(low, _AGO, 2)]
    micros = F.unix_micros(now)
    iso = F.when(raw.rlike(_ISO), F.replace(raw, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"))
    return (
        F.when(low.isin("today", "just posted", "just now", "new"), now)
        .when(low == "yesterday", F.timestamp_micros(micros - 86_400_000_000))
        .when(low.rlike(_AGO), F.timestamp_micros(micros - ago * 1_000_000))
        .when(low.rlike(r"^-*\d+$"), epoch(low.try_cast("double")))
        .otherwise(iso)
    )


def sap_date(value: Column) -> Column:
    """/Date(milliseconds)/ or ISO 8601."""
    ms = F.regexp_extract(value, r"/Date\((-?\d+)", 1)
    return F.when(ms != "", F.timestamp_millis(ms.try_cast("long"))).otherwise(F.replace(value, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"))


def age_hours(posted_at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(posted_at)) / F.lit(3.6e9)


def backoff_seconds(attempts: Column, base: float = 30.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempts))


def min_years(text: Column) -> Column:
    """The least figure of all experience requirements in a text, or null."""
    low = F.lower(blank(text))
    single = r"(?:minimum|min\.?|at least|atleast)\s*" + YEARS_SINGLE
    found = [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in (YEARS_RANGE, _NUMBER + r"\s*\+\s*(?:years?|yrs?)", single)]
    return F.array_min(F.transform(F.concat(*found), lambda x: x.cast("double")))
