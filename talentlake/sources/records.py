"""CSV files cut at record ends, so that one large file is read by many tasks and its rows keep their numbers.

Spark hands out lines by blocks of a file, wherever these begin.  Whether a line begins inside a quoted field follows from the quotes before it: those of the
earlier blocks, of which there is one count a block, and those of its own block.  So records are numbered through all blocks,
and only records of several lines are put together.  A quote that is never closed is refused, as its record would be the rest of the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.operators.shared import written


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, value): the records of CSV files with their number in their file, from 1; blank lines are none.

    Line ends within a field become line feeds.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = written(lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))))
    inner = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # the lines of a block
    counts = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    blocks = counts.withColumn("quotes_before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    odd = counts.groupBy("file").agg(F.sum("n").alias("n")).where("n % 2 = 1").limit(1).collect()
    if odd:
        raise ValueError(f"a quote is not closed in {odd[0]['file']}")
    marked = lines.join(blocks.select("file", "block", "quotes_before"), ["file", "block"])
    before = F.col("quotes_before") + F.coalesce(F.sum("quotes").over(inner), F.lit(0))
    marked = marked.withColumn("outside", before % 2 == 0)
    marked = written(marked.withColumns({"first": F.col("outside") & (F.col("value") != ""), "whole": F.col("outside") & (F.col("quotes") % 2 == 0)}).where("NOT (outside AND value = '')"))
    starts = marked.groupBy("file", "block").agg(F.count_if("first").alias("n"))
    starts = starts.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum(F.col("first").cast("long")).over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    numbered = marked.join(starts.select("file", "block", "earlier"), ["file", "block"]).withColumn("record_no", F.col("earlier") + own)
    parts = numbered.where("NOT whole").groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    several = parts.select("file", "record_no", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    return numbered.where("whole").select("file", "record_no", "value").unionByName(several)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, columns...) of CSV files with one header: all columns are text, row_no counts data rows of a file from 1.

    A byte order mark and fields beyond the header are ignored, missing fields are null, as are empty ones.  Files without a record give no rows.
    """
    records = written(csv_records(spark, path))
    head = records.where("record_no = 1").orderBy("file").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "file string, row_no long")
    line = head[0]["value"].lstrip("﻿")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    commas = line.count(",") + 1  # fields at most
    first = spark.createDataFrame([(line,)], "v string").select(F.from_csv("v", ", ".join(f"c{k} string" for k in range(commas)), options).alias("r")).first()["r"]
    names = [x for x in first if x is not None]
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    parsed = records.where("record_no > 1").select("file", (F.col("record_no") - 1).alias("row_no"), F.from_csv("value", schema, options).alias("r"))
    return parsed.select("file", "row_no", *[F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])
