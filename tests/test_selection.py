"""Medians by histograms, positions and pages by ranges, writes by buckets."""

import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talentlake.operators.buckets import Buckets
from talentlake.operators.selection import Ranked, medians


@pytest.mark.parametrize(("bins", "few"), [(4096, 10_000), (2, 0), (3, 5)])
def test_medians(spark, bins, few):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([rng.random() * 10 ** rng.randrange(6), 5.0, -3.0, 0.1])) for _ in range(400)]
    rows += [("one", 1, 7.5), ("two", 1, 1.0), ("two", 1, 2.0), ("none", 1, None), ("none", 1, float("nan")), ("odd", 1, float("inf")), ("odd", 1, 4.0), ("same", 1, 3.3), ("same", 1, 3.3)]
    got = {(r["g"], r["h"]): r["median"] for r in medians(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", bins, few).collect()}
    by = {}
    for g, h, v in rows:
        if v is not None and v == v and v != float("inf"):
            by.setdefault((g, h), []).append(v)
    assert got == {k: statistics.median(v) for k, v in by.items()}
    assert medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_ranked(spark, tmp_path):
    """A third of all rows has one value; the key that ends the order lets it be split."""
    rng = random.Random(3)
    rows = [(k, 5.0 if k % 3 == 0 else rng.choice([None, round(rng.random() * 9, 1)])) for k in range(900)]
    frame = spark.createDataFrame(rows, "k int, v double").repartition(5)
    ranked = Ranked.build(frame, [F.col("v").desc_nulls_last(), F.col("k")], str(tmp_path / "r"), parts=8)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["k"], r["v"]) for r in ranked.rows().orderBy("position").collect()] == want and ranked.total == 900
    assert len(ranked.starts) == 8 and max(n for _, n in ranked.starts.values()) < 3 * 900 / 8
    for skip, limit in ((0, 5), (440, 130), (895, 50), (900, 5), (0, 0)):
        page = ranked.page(skip, limit)
        assert [(r["k"], r["v"]) for r in page.collect()] == want[skip : skip + limit]
    assert "PartitionFilters: [" in ranked.page(450, 10)._jdf.queryExecution().executedPlan().toString()
    nothing = Ranked.build(frame.limit(0), [F.col("k")], str(tmp_path / "n"), parts=4)
    assert nothing.total == 0 and nothing.page(0, 5).count() == 0 and nothing.rows().count() == 0


def files(path):
    """The data files of each bucket."""
    out = {}
    for f in Path(path).glob("bucket=*/*.parquet"):
        out.setdefault(f.parent.name, set()).add(f.name)
    return out


def test_buckets(spark, tmp_path):
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp")
    path = str(tmp_path / "t")
    table = Buckets(spark, path, "k long, v string, created_at timestamp, updated_at timestamp", ["k"], 8)
    rows = lambda keys, v: spark.createDataFrame([(k, f"{v}{k}") for k in keys], "k long, v string")
    held = lambda: {r["k"]: (r["v"], r["created_at"].year, r["updated_at"].year) for r in table.rows().collect()}
    assert held() == {}
    table.upsert(rows(range(40), "a"), at(2001))
    want = {k: (f"a{k}", 2001, 2001) for k in range(40)}
    assert held() == want
    before = files(path)
    table.upsert(rows([3, 100], "b"), at(2002))
    want |= {3: ("b3", 2001, 2002), 100: ("b100", 2002, 2002)}
    after = files(path)
    changed = {b for b in after if after[b] != before.get(b)}
    assert held() == want and 1 <= len(changed) <= 2  # the other folders' files are the same ones
    table.update(rows([5, 777], ""), {"v": F.concat(F.col("v"), F.lit("!"))}, at(2003))
    want[5] = ("a5!", 2001, 2003)
    table.insert_missing(rows([5, 200], "c"), at(2004))
    want[200] = ("c200", 2004, 2004)
    assert held() == want
    table.delete(rows(range(40), ""))
    assert held() == {k: want[k] for k in (100, 200)} and [r["k"] for r in table.get(rows([100, 1], "")).collect()] == [100]
    table.delete(rows([100, 200, 300], ""))
    table.delete(rows([], ""))
    assert held() == {}
    table.upsert(rows([1], "z"), at(2005))
    assert held() == {1: ("z1", 2005, 2005)}


def test_discard(spark):
    """What was written on the way goes when it is told to; results stored elsewhere stay."""
    from talentlake.operators import shared

    shared.discard(spark)
    made = shared.written(spark.range(5))
    files = [Path(f.removeprefix("file:").replace("///", "/")) for f in made.inputFiles()]
    assert made.count() == 5 and files and all(f.exists() for f in files)
    assert shared.discard(spark) == 1 and not any(f.exists() for f in files) and shared.discard(spark) == 0
