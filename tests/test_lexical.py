"""BM25 over stored postings against the formula, word by word."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talentlake.operators.lexical import Postings
from talentlake.operators.search import hybrid_search


def slow(texts, query, limit):
    said = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts if i is not None}
    mean, n = sum(map(len, said.values())) / len(said), len(said)
    out = {}
    for w in query:
        df = sum(w in x for x in said.values())
        for i, x in said.items():
            if tf := x.count(w):
                out[i] = out.get(i, 0) + math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return [(i, round(s, 9)) for s, i in sorted((-s, i) for i, s in out.items())][:limit]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randrange(0, 40))) + rng.choice([" Hot!", " hot; HOT", ""])) for i in range(200)]
    return [*docs, (500, None), (501, ""), (502, "The, of -"), (None, "hot w1"), (503, "w1 w2 w3"), (504, "w1 w2 w3")]


def test_search(spark, texts, tmp_path):
    """Two segments give what one would; ties go by key."""
    frame = spark.createDataFrame(texts, "id long, text string")
    index = Postings(spark, str(tmp_path / "p"), buckets=16)
    index.add(frame.where("id IS NULL OR id % 3 > 0"), ["text"])
    index.add(frame.where("id % 3 = 0"), ["text"])
    for query, tokens in (("hot w59 of the w3", ["hot", "w59", "w3"]), ("W1, w1!", ["w1"]), ("hot", ["hot"])):
        got = [(r["id"], round(-r["score"], 9)) for r in index.search(query, 25).collect()]
        assert got == slow(texts, tokens, 25) and got
    assert index.search("the of nothing").count() == 0 and index.search("").count() == 0
    few = index.search("hot w3", None, among=frame.where("id < 10")).collect()
    assert {r["id"] for r in few} <= set(range(10)) and [r["id"] for r in few] == [i for i, _ in slow(texts, ["hot", "w3"], None) if i < 10]


def test_folders(spark, texts, tmp_path):
    """A query reads the folders of its tokens only."""
    index = Postings(spark, str(tmp_path / "p"), buckets=16)
    index.add(spark.createDataFrame(texts, "id long, text string"), ["text"])
    read = index.of(["hot", "w3"], "postings")
    files = {r["f"].split("bucket=")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(files) <= 2 and "PartitionFilters: [bucket" in read._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket")


def test_empty(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "p"), buckets=16)
    index.add(spark.createDataFrame([], "id long, text string"), ["text"])
    index.add(spark.createDataFrame([(1, "hot")], "id long, text string"), ["text"])
    assert [r["id"] for r in index.search("hot").collect()] == [1]


def test_hybrid(spark, texts, tmp_path):
    index = Postings(spark, str(tmp_path / "p"), buckets=16)
    frame = spark.createDataFrame(texts, "id long, text string").where("id IS NOT NULL").withColumn("embedding", F.array(F.sin(F.col("id")), F.cos(F.col("id"))))
    index.add(frame, ["text"])
    plain = hybrid_search(frame, [1.0, 0.5], "w1 w2 w3", "id", ["text"], 10)
    scored = hybrid_search(frame, [1.0, 0.5], "w1 w2 w3", "id", ["text"], 10, alpha=0.2, postings=index)
    best = {r["id"] for r in index.search("w1 w2 w3", 20).collect()}
    assert scored.count() == plain.count() == 10 and len({r["id"] for r in scored.collect()} & best) > 3
