"""Operator 2: quality rules with thresholds that follow the data.

A few ratios of each text are sketched per language and source; a text fails where a
ratio lies outside the fences that its group's quartiles set.  The sketch is a table of
counts in buckets of equal relative width (a value and its bucket differ by 2 % at
most), so sketches merge by adding: partial sums before the shuffle, sources into their
language, languages into the whole, with the same result in any order.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than 20 words);
a null lang or source is a group of its own; a group's quartiles are drawn towards those of its language, and these towards those of
all texts, by one rule for all sizes (``fences``); ties can't occur, as fences are inclusive;
repeated rows count each time and each keep their row; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.llm.common import add_columns, cut, table
from talentlake.llm.textstats import base_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: ratio -> (expression, least spread between quartiles, is there a lower fence)
RATIOS: dict[str, tuple[str, float, bool]] = {
    "word_length": ("word_chars / greatest(n_words, 1)", 0.3, True),
    "symbol_share": ("n_symbols / greatest(n_words, 1)", 0.05, False),
    "dup_line_share": ("n_dup_lines / greatest(n_words, 1)", 0.02, False),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 0.06, False),
}
_LEAST, _GAMMA = 1e-3, 1.02


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source with the base counts, the base verdict and the ratios."""
    counts = add_columns(docs.select("doc_id", "lang", "source", "text"), ["text"], ", ".join(f"{c} long" for c in COUNTS), base_counts).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumns({k: F.expr(x) for k, (x, _, _) in RATIOS.items()})


def _bucket(value: Column) -> Column:
    return F.when(value <= _LEAST, 0).otherwise(1 + F.floor(F.log(value / _LEAST) / math.log(_GAMMA))).cast("int")


def _value(bucket: Column) -> Column:
    """The upper end of a bucket."""
    return F.when(bucket == 0, 0.0).otherwise(_LEAST * F.pow(F.lit(_GAMMA), bucket))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketches, over all texts that pass the base rule."""
    long = counts.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(F.col(k)).alias("bucket")) for k in RATIOS])).alias("r")
    )
    return long.groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q25 and q75 of each sketch; keys name the groups."""
    total = W.partitionBy(*keys, "ratio")
    run = total.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n")).withColumns({"below": F.sum("n").over(run), "total": F.sum("n").over(total)})
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), _value(quartile(0.25)).alias("q25"), _value(quartile(0.75)).alias("q75"))


def fences(sketch: DataFrame, reach: float = 3.0, prior: float = 200.0) -> DataFrame:
    """One row per (lang, source): the lower and upper fence of each ratio.

    A quartile of a group of n texts is the mean of its own, weighted n, and its language's, weighted ``prior``; a language's is drawn
    towards the whole corpus's in the same way.  So every group's own sketch counts at every size, a large one's nearly alone.
    """
    own, lang, whole = (_quartiles(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("lang2"), F.col("ratio").alias("ratio2"), *[F.col(c).alias(f"{c}2") for c in ("total", "q25", "q75")])
    whole = whole.select(F.col("ratio").alias("ratio3"), *[F.col(c).alias(f"{c}3") for c in ("q25", "q75")])
    joined = own.join(lang, own["lang"].eqNullSafe(lang["lang2"]) & (own["ratio"] == lang["ratio2"])).join(whole, own["ratio"] == whole["ratio3"])
    drawn = lambda n, q, to: (F.col(n).cast("double") * q + prior * to) / (F.col(n).cast("double") + prior)
    low, high = (drawn("total", F.col(c), drawn("total2", F.col(f"{c}2"), F.col(f"{c}3"))) for c in ("q25", "q75"))
    least = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[1])])[F.col("ratio")]
    lower = F.col("ratio").isin(*[k for k, v in RATIOS.items() if v[2]])
    spread = F.greatest(F.col("q75_") - F.col("q25_"), least) * reach
    return (
        joined.withColumns({"q25_": low, "q75_": high})
        .withColumns({"low": F.when(lower, F.col("q25_") - spread), "high": F.col("q75_") + spread})
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("ratio") == k, F.col(end))).alias(f"{k}_{end}") for k in RATIOS for end in ("low", "high")])
    )


def judge(docs: DataFrame, reach: float = 3.0, prior: float = 200.0) -> DataFrame:
    """The counts of each document with base_failed, its group's fences, the ratios outside them and kept."""
    counts = cut(counted(docs))
    limits = fences(sketches(counts), reach, prior)
    limits = limits.withColumnsRenamed({"lang": "lang_of", "source": "source_of"})
    joined = counts.join(limits, counts["lang"].eqNullSafe(limits["lang_of"]) & counts["source"].eqNullSafe(limits["source_of"]), "left").drop("lang_of", "source_of")
    out = F.array_compact(F.array(*[F.when((F.col(k) < F.col(f"{k}_low")) | (F.col(k) > F.col(f"{k}_high")), F.lit(k)) for k in RATIOS]))
    return joined.withColumn("outside", out).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.concat_ws(",", "outside").alias("outside"))
