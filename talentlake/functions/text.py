"""String functions as Column expressions: tokens, keys, hashes, URLs and slugs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in fingerprints.
STOPWORDS = ("the", "a", "an", "and", "or", "for", "of", "to", "in", "at", "on", "with", "job", "role")


def blank(x: Column) -> Column:
    """The value, or the empty text for null."""
    return F.coalesce(x, F.lit(""))


def filled(*xs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, where an expression that names it often would compute it as often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(x: Column) -> Column:
    """The lower-case ASCII letter and digit runs."""
    return F.regexp_extract_all(F.lower(blank(x)), F.lit("[a-z0-9]+"), F.lit(0))


def word_key(x: Column) -> Column:
    return F.array_join(words(x), " ")


def content_tokens(*xs: Column) -> Column:
    """Distinct words of all parts, without stopwords and single characters, in order of first appearance."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_except(F.regexp_extract_all(F.lower(F.concat_ws(" ", *xs)), F.lit("[a-z0-9]{2,}"), F.lit(0)), stop)


def query_tokens(text: str) -> list[str]:
    """The content tokens of a text that is known on the driver."""
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in STOPWORDS))


def holds_token(low: Column, token: str) -> Column:
    """Whether a lower-case text has a token; the plain search, which is cheap, comes before the pattern."""
    return F.contains(low, F.lit(token)) & low.rlike(f"(?<![a-z0-9]){token}(?![a-z0-9])")


def fingerprint(*xs: Column) -> Column:
    """SHA-256 of the sorted content tokens; the empty text if there are none."""
    # no token is empty, so the joined text is empty only without tokens
    return once(F.array_join(F.sort_array(content_tokens(*xs)), " "), lambda said: F.when(said == "", "").otherwise(F.sha2(said, 256)))


def url_key(url: Column) -> Column:
    """Host without a leading www. and path without trailing slashes, lower-cased; scheme, query and fragment go.

    By patterns, as parse_url gives null for addresses that a lenient reader accepts.
    """
    rest = F.regexp_replace(blank(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/;]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/;]*", ""), r"(;[^/]*)$", "")
    return F.concat(host, F.lower(F.regexp_replace(path, r"/+$", "")))


def seed_url_key(url: Column) -> Column:
    """As url_key, but with the query kept, for merging company seeds."""
    rest = F.regexp_replace(F.lower(F.trim(blank(url))), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^www\.", ""), r"#.*$", ""), r"/+$", "")


def job_key(company: Column, role: Column, place: Column, url: Column) -> Column:
    """The identity hash of a posting."""
    return F.sha2(F.concat_ws("|", word_key(company), word_key(role), word_key(place), url_key(url)), 256)


def company_key(name: Column) -> Column:
    """A company name for lookups: trimmed, lower-case, single blanks."""
    return F.lower(F.regexp_replace(F.trim(blank(name)), r"\s+", " "))


#: Accented Latin letters and what they decompose to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def slug(x: Column) -> Column:
    """Lower-case words joined by single hyphens; & reads as "and", accents fall away."""
    plain = F.translate(F.lower(blank(x)), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^\x00-\x7F]", ""), r"[^a-z0-9]+", "-"), F.lit("-"))


def content_key(model: Column, text: Column) -> Column:
    """Cache key of an embedding: SHA-256 of model, a zero byte and text."""
    return F.sha2(F.concat(blank(model), F.char(F.lit(0)), blank(text)), 256)


def truthy_flag(x: Column) -> Column:
    """true or false for the usual spellings, else null."""
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin("true", "1", "yes", "y", "t", "on"), True).when(v.isin("false", "0", "no", "n", "f", "off"), False)


def listed(x: Column) -> Column:
    """The parts of a text split at ; or else at |, trimmed, without empty ones."""
    parts = F.when(F.contains(x, F.lit(";")), F.split(x, ";")).when(F.contains(x, F.lit("|")), F.split(x, r"\|")).otherwise(F.array(x))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def whole_word(terms: tuple[str, ...]) -> str:
    """A pattern that finds any of the terms where no a-z letter adjoins."""
    escaped = [re.sub(r"([.^$*+?{}\[\]\\|()\-/])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t))]
    return "(?<![a-z])(?:" + "|".join(escaped) + ")(?![a-z])"


def title_case(x: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    pieces = F.regexp_extract_all(blank(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")
