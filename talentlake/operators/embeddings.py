"""The life of stored embeddings: models, freshness, migration to another model, resumes and the metrics of all that."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.text import blank, filled
from talentlake.functions.vectors import hash_embedding

EMBEDDING_VERSION = 1


@dataclass(frozen=True)
class Model:
    """An embedding model, and what is put before queries and documents."""

    name: str
    dimensions: int = 384
    max_length: int = 512
    query_prefix: str = ""
    document_prefix: str = ""


#: The known models with their prefixes.
MODELS = {
    m.name: m
    for m in (
        Model("BAAI/bge-small-en-v1.5", 384, 512, "Represent this resume for retrieving relevant job descriptions: "),
        Model("BAAI/bge-base-en-v1.5", 768, 512, "Represent this resume for retrieving relevant job descriptions: "),
        Model("intfloat/e5-base-v2", 768, 512, "query: ", "passage: "),
        Model("sentence-transformers/all-MiniLM-L6-v2", 384, 256),
    )
}


def model_of(name: str, dimensions: int = 384) -> Model:
    """The known model of a name, or one of the given dimensions without prefixes."""
    return MODELS.get(name, Model(name, dimensions))


def model_text(text: Column, model: Model, query: bool = False) -> Column:
    """What a model reads for a text."""
    prefix = model.query_prefix if query else model.document_prefix
    return F.concat(F.lit(prefix), blank(text)) if prefix else blank(text)


def content_hash(text: Column) -> Column:
    return F.sha2(blank(text), 256)


def is_fresh(text: Column, model: Model, version: int = EMBEDDING_VERSION) -> Column:
    """Whether a row's embedding (columns embedding, embedding_meta) is that of this text, model and version."""
    meta = F.col("embedding_meta")
    same = (meta["content_hash"] == content_hash(text)) & (meta["model_name"] == model.name) & (meta["embedding_version"] == version)
    return F.coalesce((F.size("embedding") > 0) & same, F.lit(False))


Encoder = Callable[[Column], Column]


def encoded(text: Column, model: Model, encoder: Encoder | None) -> Column:
    """The vectors of texts by an encoder: the one given, or hashing.  A model that is known by name is no hashing, and is refused without its encoder."""
    if encoder is not None:
        return encoder(text)
    if model.name in MODELS:
        raise ValueError(f"{model.name} needs an encoder")
    return hash_embedding(text, model.dimensions)


def _stamp(model: Model, text: Column, now: Column, version: int) -> Column:
    return F.struct(
        F.lit(model.name).alias("model_name"), F.lit(version).alias("embedding_version"), F.lit(model.dimensions).alias("dimensions"),
        content_hash(text).alias("content_hash"), now.alias("generated_at"),
    )


def embed(rows: DataFrame, text: Column, model: Model, now: Column, version: int = EMBEDDING_VERSION, renew: Column | None = None, encoder: Encoder | None = None) -> DataFrame:
    """``rows`` with embedding, embedding_meta and renewed; only rows of which ``renew`` holds (by default those that aren't fresh) are embedded.

    Missing columns count as null.  Fresh rows pass the encoder as nulls, so that one pass serves both kinds.
    """
    for name, kind in (("embedding", "array<float>"), ("embedding_meta", "struct<model_name string, embedding_version int, dimensions int, content_hash string, generated_at timestamp>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    marked = rows.withColumn("renewed", ~is_fresh(text, model, version) if renew is None else F.coalesce(renew, F.lit(False)))
    vector = encoded(F.when(F.col("renewed"), model_text(text, model)), model, encoder)
    return marked.withColumns({
        "embedding": F.when(F.col("renewed"), vector).otherwise(F.col("embedding")),
        "embedding_meta": F.when(F.col("renewed"), _stamp(model, text, now, version)).otherwise(F.col("embedding_meta")),
    })


def embed_stats(done: DataFrame) -> DataFrame:
    """One row: total, skipped and embedded of ``embed``."""
    return done.agg(F.count("*").alias("total"), F.count_if(~F.col("renewed")).alias("skipped"), F.count_if("renewed").alias("embedded"))


def _source(model: Model) -> tuple[Column, Column]:
    source = F.coalesce(F.col("embedding_meta.model_name"), F.lit("none"))
    return source, (source != model.name) | F.col("embedding").isNull()


def from_models(stored: DataFrame, model: Model) -> DataFrame:
    """(model_name, n): the rows that ``migrate`` would embed anew, by the model of their embedding ("none" without one)."""
    source, stale = _source(model)
    return stored.where(stale).groupBy(source.alias("model_name")).agg(F.count("*").alias("n"))


def migrate(stored: DataFrame, text: Column, model: Model, now: Column, encoder: Encoder | None = None) -> DataFrame:
    """Stored rows with those of another model, or of none, embedded by this one."""
    return embed(stored, text, model, now, renew=_source(model)[1], encoder=encoder)


def embed_resumes(requests: DataFrame, stored: DataFrame, model: Model, now: Column, version: int = EMBEDDING_VERSION, force: bool = False, encoder: Encoder | None = None) -> DataFrame:
    """One record a request: the stored one where its content hasn't changed, else a new one; and regenerated.

    Requests are (resume_id, content, label, skills, preferred_locations, max_experience_years); a label or list that a request leaves
    empty stays as stored.  resume_id must be unique on both sides.
    """
    kept = ("label", "skills", "preferred_locations", "max_experience_years", "content_hash", "embedding", "model_name", "embedding_version", "dimensions", "generated_at")
    old = stored.select("resume_id", *[F.col(c).alias(f"__{c}") for c in kept])
    both = requests.join(old, "resume_id", "left")
    same = (F.col("__content_hash") == content_hash(F.col("content"))) & (F.col("__model_name") == model.name) & (F.col("__embedding_version") == version) & (F.size("__embedding") > 0)
    both = both.withColumn("regenerated", F.lit(True) if force else ~F.coalesce(same, F.lit(False)))
    listed = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"__{c}", F.array().cast("array<string>")))
    fresh = {
        "label": F.coalesce(filled(F.col("label")), F.col("__label")), "skills": listed("skills"), "preferred_locations": listed("preferred_locations"),
        "max_experience_years": F.coalesce("max_experience_years", F.lit(2.0)), "content_hash": content_hash(F.col("content")),
        "embedding": encoded(F.when(F.col("regenerated"), model_text(F.col("content"), model, query=True)), model, encoder),
        "model_name": F.lit(model.name), "embedding_version": F.lit(version), "dimensions": F.lit(model.dimensions), "generated_at": now,
    }
    return both.select("resume_id", *[F.when(F.col("regenerated"), fresh[c]).otherwise(F.col(f"__{c}")).alias(c) for c in kept], "regenerated")


#: The observed steps, by the name under which they are reported.
STEPS = {
    "embed_query_ms": "ai_embed_query_seconds", "embed_documents_ms": "ai_embed_documents_seconds", "embed_batch_ms": "ai_embed_job_batch_seconds",
    "vector_search_ms": "ai_vector_search_seconds", "rerank_ms": "ai_rerank_seconds", "ranking_ms": "ai_rank_seconds",
}


def metrics_report(observed: DataFrame) -> DataFrame:
    """One row: the mean of each step in milliseconds (0 if never observed), from (name, seconds); and the cache's hits, misses and hit rate."""
    mean = lambda name: F.round(F.coalesce(F.avg(F.when(F.col("name") == name, F.col("seconds"))), F.lit(0.0)) * 1000, 3)
    hits, misses = F.count_if(F.col("name") == "cache_hit"), F.count_if(F.col("name") == "cache_miss")
    return observed.agg(*[mean(v).alias(k) for k, v in STEPS.items()], hits.alias("hits"), misses.alias("misses"), F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)).alias("hit_rate"))
