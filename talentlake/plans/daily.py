"""The whole run over a day's postings: validate, normalise, filter, deduplicate, embed, rank, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.vectors import text_cosine
from talentlake.operators.buckets import Buckets
from talentlake.operators.rank import Resume, rank
from talentlake.operators.shared import written
from talentlake.plans import dedup, filters
from talentlake.plans.normalize import job_text, normalize


@dataclass(frozen=True)
class Run:
    """The tables of a run; each stage's is written where a later one reads it more than once."""

    rejected: DataFrame
    verdicts: DataFrame
    ranked: DataFrame
    counts: dict[str, int]


def daily(raw: DataFrame, now: Column, resume: Resume, chain: Sequence[filters.Filter], aliases: DataFrame | None = None, priorities: DataFrame | None = None, table: Buckets | None = None, incremental: bool = False) -> Run:
    """Runs all stages; ``table`` (key job_hash) takes those columns of the ranked jobs, and their score, that it has, and with ``incremental`` those that it holds already are skipped.

    Similarity is that of hashed texts.
    """
    jobs = filters.with_rejection(normalize(filters.validated(raw), now, aliases), chain)
    kept = written(filters.passed(jobs))
    verdicts = written(dedup.deduplicate(kept))
    unique = kept.join(verdicts.where("NOT is_duplicate").select("seq"), "seq", "left_semi")
    if incremental and table is not None:
        unique = unique.join(table.rows().select("job_hash"), "job_hash", "left_anti")
    scored = unique.withColumn("similarity", text_cosine(job_text(unique), resume.embedding, len(resume.embedding))) if len(resume.embedding) else unique
    ranked = written(rank(scored, resume, now, priorities).drop("similarity"))
    if table is not None:
        table.upsert(ranked.withColumn("score", F.col("match.score")).select(*[c for c in table.schema.fieldNames() if c not in ("created_at", "updated_at")]), now)
    counts = {"kept": kept.count(), "unique": verdicts.where("NOT is_duplicate").count(), "ranked": ranked.count()}
    return Run(filters.summary(jobs), verdicts, ranked, counts)
