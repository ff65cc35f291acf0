"""Batches against a stored index: what one run over all of them gives."""

import random

import pytest

from talentlake.plans import dedup
from talentlake.plans.accepted import Accepted
from test_dedup import postings


def raw(rng, n, vectors):
    words = [f"w{k}" for k in range(26)]
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    out = []
    for seq in range(n):
        base = rng.randrange(14)
        tokens = [w for k, w in enumerate(words) if (k + base) % 13 < 11][: rng.choice([22, 21, 20])]
        near = [x + rng.choice([0, 0.1, 0.4]) * rng.gauss(0, 1) for x in rng.choice(middles)]
        v = rng.choice([None, near, near, [0.0] * 6]) if vectors else None
        out.append((seq, f"h{rng.randrange(150)}", rng.choice([None, f"u{rng.randrange(200)}"]), f"r{rng.randrange(150)}", " ".join(tokens) + f" x{seq // 5}" if rng.random() < 0.9 else None, v))
    return out


@pytest.mark.parametrize("vectors", [False, True])
def test_batches(spark, tmp_path, vectors):
    rng = random.Random(21)
    rows = raw(rng, 160, vectors)
    frame = spark.createDataFrame([(r[0], r[5]) for r in rows], "seq long, embedding array<double>")
    every = postings(spark, [r[:5] for r in rows])
    every = every.join(frame, "seq") if vectors else every
    want = sorted(map(tuple, dedup.deduplicate(every).collect()))
    index, got = Accepted(spark, str(tmp_path / "i"), buckets=8), []
    for low, high in ((0, 70), (70, 71), (71, 160)):
        got += index.deduplicate(every.where(f"seq >= {low} AND seq < {high}")).collect()
    assert sorted(map(tuple, got)) == want and any(r[1] and r[4] < 70 <= r[0] for r in want)
    assert index.stored("rows").count() == sum(not r[1] for r in want) and [n for n, _ in index.batches()] == [0, 1, 2]


def test_broken_batch(spark, tmp_path):
    """A batch that broke off before its entry leaves nothing behind; an empty one is no batch; old numbers are refused."""
    rows = postings(spark, [(k, f"h{k % 3}", f"u{k}", f"r{k}", f"text number {k}") for k in range(6)])
    index = Accepted(spark, str(tmp_path / "i"), buckets=4)
    index.deduplicate(rows.where("seq < 3"))
    index.stored("rows").drop("batch").withColumn("bucket", index._bucket("seq")).write.partitionBy("bucket").parquet(str(tmp_path / "i/rows/batch=1"))
    assert index.stored("rows").count() == 3 and index.deduplicate(rows.limit(0)).count() == 0
    got = {r["seq"]: r["matched_seq"] for r in index.deduplicate(rows.where("seq >= 3")).collect()}
    assert got == {3: 0, 4: 1, 5: 2} and index.stored("rows").count() == 3
    with pytest.raises(ValueError, match="larger"):
        index.deduplicate(rows.where("seq = 5"))
