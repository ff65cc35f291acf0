"""A corpus pipeline out of the training-data operators.

Five stages in order: language ID, line dedup, MinHash near-dedup, benchmark
decontamination, BPE encoding and decoding.  Each works on all that the one before kept, is written as Parquet in
the folder that driver and executors share, and is read again; a lost executor costs
the tasks of one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import bpe, decontaminate, langid, line_dedup, near_dup
from talentlake.llm.common import add_columns, shared_dir, table

#: No SQL engine compresses with dictionaries or reads BPE merges; tests/llm hold the stages against brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with certainty, under that language; null, empty and letterless texts go, as do near ties."""
    found = langid.identify(docs.select(*COLUMNS), langid.excerpts(docs), narrow=0.005)
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds in an aligned block go, and documents of which nothing is left."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _measured(done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one of least doc_id; rows that repeat it go too."""
    return near_dup.without_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; documents of which nothing is left go."""
    done = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _measured(done.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; text is what the ids decode to."""
    path = bpe.vocabulary_path()

    def make(texts: list[str | None]) -> list[list]:
        vocab = bpe.bpe(path)
        ids = vocab.encode(texts)
        return [[x.astype("int32") for x in ids], [len(x) for x in ids], [vocab.decode(x) for x in ids]]

    both = add_columns(docs.select(*COLUMNS), ["text"], "token_ids array<int>, n_tokens long, __decoded string", make)
    return both.withColumn("text", F.col("__decoded")).select(*COLUMNS, "n_tokens", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
