"""Exact vector search, lexical search and their blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.functions.text import holds_token, query_tokens
from talentlake.functions.vectors import cosine_to, hash_embedding
from talentlake.operators.lexical import Postings


def vector_search(rows: DataFrame, query: Sequence[float], key: str, limit: int | None = 10, skip: int = 0, threshold: float = 0.0, where: Column | None = None, vector: str = "embedding") -> DataFrame:
    """(key, score) of the nearest rows by cosine, best first, ties by key.

    Without a limit all rows are found.  A zero or empty query finds nothing; a threshold counts if above 0; ``where`` is applied before scoring.
    """
    if not any(query):
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    if where is not None:
        rows = rows.where(where)
    scored = rows.where(F.col(vector).isNotNull()).select(key, cosine_to(query, F.col(vector)).alias("score"))
    if threshold > 0:
        scored = scored.where(F.col("score") >= threshold)
    hits = scored.orderBy(F.desc("score"), key).offset(skip)
    return hits if limit is None else hits.limit(limit)


def text_search(rows: DataFrame, text: str, key: str, columns: Sequence[str], limit: int = 10, where: Column | None = None) -> DataFrame:
    """(key, score) by the number of distinct query tokens that a row holds; rows without any are left out."""
    wanted = query_tokens(text)
    if where is not None:
        rows = rows.where(where)
    low = rows.select(key, F.lower(F.concat_ws(" ", *columns)).alias("low"))
    hits = sum((holds_token(F.col("low"), w).cast("double") for w in wanted), F.lit(0.0))
    # what has no token goes after the limit, as a filter below it would count the tokens twice
    return low.select(key, hits.alias("score")).orderBy(F.desc("score"), key).limit(limit).where("score > 0")


def scaled(hits: DataFrame) -> DataFrame:
    """The scores of a search's best rows brought to 0..1 by their least and largest; all 1 where they are equal."""
    best = W.partitionBy()  # as many rows as the search's limit
    low, span = F.min("score").over(best), F.max("score").over(best) - F.min("score").over(best)
    return hits.withColumn("score", F.when(span > 0, (F.col("score") - low) / span).otherwise(1.0))


def blended(near: DataFrame, hits: DataFrame, key: str, limit: int, alpha: float = 0.6) -> DataFrame:
    """(key, score): ``alpha`` of the scaled vector scores and the rest of the scaled lexical ones; a side that lacks a row counts 0."""
    v, t = scaled(near).withColumnRenamed("score", "v"), scaled(hits).withColumnRenamed("score", "t")
    blend = F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("t", F.lit(0.0))
    return v.join(t, key, "full").select(key, blend.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def hybrid_search(
    rows: DataFrame, query: Sequence[float], text: str, key: str, columns: Sequence[str], limit: int = 10, alpha: float = 0.6,
    where: Column | None = None, threshold: float = 0.0, texts: DataFrame | None = None, postings: Postings | None = None,
) -> DataFrame:
    """(key, score) by a blend of a vector leg and a lexical leg, each of its best 2 * limit rows.

    ``texts`` holds the text columns where they lie in a table of their own; each leg then reads its own table alone.
    With ``postings`` the lexical leg is BM25 over these; otherwise it counts the query's distinct tokens in all texts.
    """
    near = vector_search(rows, query, key, 2 * limit, where=where, threshold=threshold)
    if not text.strip():
        return near.limit(limit)
    if postings is not None:
        among = None if where is None else (rows if texts is None else texts).where(where)
        return blended(near, postings.search(text, 2 * limit, among), key, limit, alpha)
    return blended(near, text_search(rows if texts is None else texts, text, key, columns, 2 * limit, where), key, limit, alpha)


def search(
    rows: DataFrame, key: str, text: str = "", query: Sequence[float] | None = None, columns: Sequence[str] = ("text",), limit: int = 10, skip: int = 0,
    where: Column | None = None, threshold: float = 0.0, hybrid: bool = False, alpha: float = 0.6,
) -> DataFrame:
    """The search service: a text is embedded where no query vector is given, scores are rounded to four places, hits come with their rows."""
    if query is None:
        one = rows.sparkSession.createDataFrame([(text,)], "t string").select(hash_embedding(F.col("t")).alias("v")).first()
        query = one["v"]
    if hybrid:
        hits = hybrid_search(rows, query, text, key, columns, limit + skip, alpha, where, threshold).orderBy(F.desc("score"), key).offset(skip)
    else:
        hits = vector_search(rows, query, key, limit, skip, threshold, where)
    return hydrate(hits.select(key, F.round("score", 4).alias("score")), rows, key)


def hydrate(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of their rows, in order of score; a hit without a row keeps nulls."""
    return hits.join(rows, key, "left").orderBy(F.desc("score"), key)
