"""Ranks without one large task: medians of few large groups, positions of all rows, and deep pages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.operators.shared import cut, written


def medians(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """(keys, median): the exact median of the finite values of each group.

    The two middle ranks of a group are looked for in a histogram of its range, then in one of the bin that holds the rank, until that bin
    holds one value or ``few`` rows, which are sorted.  Histograms are partial sums, so no buffer or task grows with a group.
    Null values, and those that are not finite, don't count; null keys are a group; a group without values has no row.
    """
    keys = list(keys)
    own = [F.col(k).alias(f"__{k}") for k in keys]
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    data = cut(rows.where(finite).select(*own, F.col(value).cast("double").alias("__v")))
    names = [f"__{k}" for k in keys]
    bounds = data.groupBy(*names).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    ends = F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank")))
    wanted = written(bounds.withColumn("e", F.explode(ends)).select(*names, "n", "lo", "hi", "e.which", "e.rank"))
    found = None

    def add(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    def within(open_: DataFrame) -> DataFrame:
        """The values between the bounds that are still open."""
        o = open_.select(*[F.col(k).alias(f"o{k}") for k in names], "which", "rank", "lo", "hi")
        return data.join(o, [data[k].eqNullSafe(o[f"o{k}"]) for k in names] + [data["__v"].between(o["lo"], o["hi"])]).drop(*[f"o{k}" for k in names])

    while not wanted.isEmpty():
        one, small = F.col("lo") == F.col("hi"), F.col("n") <= few
        add(wanted.where(one).select(*names, "which", F.col("lo").alias("v")))
        placed = within(wanted.where(~one & small)).withColumn("at", F.row_number().over(W.partitionBy(*names, "which").orderBy("__v")) - 1)
        add(written(placed.where("at = rank").select(*names, "which", F.col("__v").alias("v"))))
        at = F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        counts = within(wanted.where(~one & ~small)).groupBy(*names, "which", "rank", at.alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(*names, "which").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))  # as many rows as bins
        before = counts.withColumn("before", F.coalesce(upto, F.lit(0)))
        chosen = before.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        wanted = written(chosen.select(*names, "n", "lo", "hi", "which", (F.col("rank") - F.col("before")).alias("rank")))
    if found is None:
        return rows.select(*keys, F.lit(0.0).alias("median")).limit(0)
    return found.groupBy(*names).agg(F.avg("v").alias("median")).select(*[F.col(f"__{k}").alias(k) for k in keys], "median")


class Ranked:
    """A table in a total order, stored as ranges with their counts below ``path``: positions and pages read what they need."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{self.path}/about").first()["schema"]))
        self.starts: dict[int, tuple[int, int]] = {}
        start = 0
        for r in spark.read.parquet(f"{self.path}/counts").orderBy("part").collect():  # a row a range
            self.starts[r["part"]] = (start, r["n"])
            start += r["n"]
        self.total = start

    @classmethod
    def build(cls, rows: DataFrame, order: Sequence[Column], path: str, parts: int | None = None) -> Ranked:
        """Stores ``rows`` in ``order``, which must leave no ties: end it with a key, so that equal values can be split too."""
        spark = rows.sparkSession
        parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()  # the range above, the place within it below
        placed = dealt.withColumn("__id", number).withColumns({"part": F.shiftright("__id", 33).cast("int"), "place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
        path = path.rstrip("/")
        placed.write.partitionBy("part").parquet(f"{path}/rows")
        spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/about")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        stored.groupBy("part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return cls(spark, path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All rows with their position, from 0."""
        starts = self.spark.createDataFrame([(p, s) for p, (s, _) in self.starts.items()], "part int, __start long")
        return self._stored().join(F.broadcast(starts), "part").withColumn("position", F.col("__start") + F.col("place")).drop("part", "place", "__start")  # a row a range

    def page(self, skip: int, limit: int) -> DataFrame:
        """The rows at positions from ``skip``, ``limit`` of them, in order; only their ranges are read."""
        hit = {p: s for p, (s, n) in self.starts.items() if s < skip + limit and skip < s + n}
        if not hit:
            return self._stored().withColumn("position", F.col("place")).drop("part", "place").limit(0)
        start = F.create_map(*[x for p, s in sorted(hit.items()) for x in (F.lit(p), F.lit(s))])[F.col("part")]
        rows = self._stored().where(F.col("part").isin(sorted(hit)))
        return rows.withColumn("position", start + F.col("place")).where((F.col("position") >= skip) & (F.col("position") < skip + limit)).drop("part", "place").orderBy("position")
