"""Blocks of products and the inverted file against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.operators import ann, blocks, search


def vectors(n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, dims))
    return [(i, (middles[i % 20] + 0.4 * rng.normal(size=dims)).round(3).tolist(), i % 5) for i in range(n)]


def brute(queries, rows, k):
    out = {}
    for q, x in queries:
        scored = sorted((-max(0.0, float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))) if any(y) else 0.0, i) for i, y in rows)
        out[q] = [(i, round(-s, 9)) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize(("rows", "block"), [(100_000, 2048), (37, 5)])
def test_best_of_each(spark, rows, block):
    """Any grid gives the same, ties by id."""
    data = [(i, v) for i, v, _ in vectors(300)] + [(1000 + i, vectors(3)[i % 3][1]) for i in range(30)] + [(2000, [0.0] * 16)]
    random.Random(1).shuffle(data)
    queries = [(i, v) for i, v, _ in vectors(23, seed=2)]
    frame = lambda x: spark.createDataFrame(x, "id long, f array<double>")
    got = {}
    for r in blocks.best_of_each(frame(queries), frame(data), 12, rows=rows, block=block).orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append((r["id"], round(r["score"], 9)))
    assert got == brute(queries, data, 12)
    assert blocks.best_of_each(frame(queries), frame([]), 3).count() == 0 and blocks.best_of_each(frame([]), frame(data), 3).count() == 0
    assert blocks.best_of_each(frame(queries), frame(data[:2]), 5).count() == 2 * len(queries)


def test_index(spark, tmp_path):
    data = vectors(2000)
    odd = [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (None, [1.0] * 16, 1), (5003, [float("nan")] + [1.0] * 15, 1)]
    frame = spark.createDataFrame(data + odd, "id long, e array<float>, label int")
    index = ann.build(frame, "id", "e", str(tmp_path / "ivf"), lists=20, calibration=100)
    assert index.rows().count() == 2000 and 1 <= index.probes < 20
    queries = spark.createDataFrame([(i, v) for i, v, _ in data[::50]], "id long, f array<double>")
    true = {(r["q"], r["id"]) for r in blocks.best_of_each(queries, frame.where("id < 2000").select("id", F.col("e").cast("array<double>").alias("f")), 10).collect()}
    got = {(r["q"], r["id"]) for r in index.search_each(queries, 10).collect()}
    assert len(got & true) >= 0.9 * len(true)
    assert {(r["q"], r["id"]) for r in index.search_each(queries, 10, probes=20, block=7).collect()} == true
    query = data[7][1]
    want = [r["id"] for r in search.vector_search(frame.where("id < 2000"), query, "id", 10, vector="e").collect()]
    assert [r["id"] for r in index.search(query, 10, exact=True).collect()] == want
    one = index.search(query, 10)
    assert len({r["id"] for r in one.collect()} & set(want)) >= 8
    # only the folders of the probed lists are read
    lists = index.nearest(query)[: index.probes]
    read = index.rows().where(F.col("list").isin(lists)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("list=")[1].split("/")[0]) for r in read} == set(lists)
    plan = index.hits(query, lists)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_condition_widens(spark, tmp_path):
    """A condition that few rows meet: further lists are read until there are enough hits."""
    data = vectors(1000)
    rare = {i for i, _, _ in data if i % 97 == 3}
    frame = spark.createDataFrame([(i, v, int(i in rare)) for i, v, _ in data], "id long, e array<float>, label int")
    index = ann.build(frame, "id", "e", str(tmp_path / "ivf"), lists=20, calibration=50)
    query = data[11][1]
    want = [r["id"] for r in search.vector_search(frame, query, "id", len(rare), where=F.col("label") == 1, vector="e").collect()]
    assert [r["id"] for r in index.search(query, len(rare), where=F.col("label") == 1, probes=1).collect()] == want and set(want) == rare
    assert index.search([0.0] * 16).count() == 0
    high = index.search(query, 1000, threshold=0.8, probes=1).collect()
    assert {r["id"] for r in high} == {r["id"] for r in search.vector_search(frame, query, "id", None, threshold=0.8, vector="e").collect()}
    with pytest.raises(ValueError, match="vector"):
        ann.build(frame.limit(0), "id", "e", str(tmp_path / "none"))


def test_best_of_distinct(spark):
    """Equal rows are kept once, with their least ids, and what comes out is what comparing all of them gives."""
    rng = np.random.default_rng(5)
    kinds = rng.standard_normal((40, 5)).round(1)
    rows = [(i, kinds[rng.integers(40)].tolist()) for i in range(3000)] + [(9000 + i, [0.0] * 5) for i in range(30)]
    asked = [(i, kinds[i % 7].tolist()) for i in range(50)]
    make = lambda x: spark.createDataFrame(x, "id long, f array<double>").repartition(5)
    kept = blocks.distinct_rows(make(rows), 6, bound=10).collect()
    by = {}
    for i, f in rows:
        by.setdefault(tuple(f), []).append(i)
    assert {tuple(r["f"]): r["ids"] for r in kept} == {f: sorted(ids)[:6] for f, ids in by.items()} and all(r["id"] == r["ids"][0] for r in kept)
    for grid in ({}, {"rows": 10, "block": 2}):
        want = blocks.best_of_each(make(asked), make(rows), 6).orderBy("q", "place").collect()
        got = blocks.best_of_distinct(make(asked), make(rows), 6, **grid).orderBy("q", "place").collect()
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r["score"] for r in got], [r["score"] for r in want])
    assert blocks.best_of_distinct(make(asked), make([]), 3).count() == 0 and blocks.best_of_distinct(make([]), make(rows), 3).count() == 0
