"""Sharding, spelling variants and centroid clustering against plain computations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talentlake.llm import centroids, sharding, spelling


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot double")


def shards_of(rows):
    """Bytes of each shard; that slots are gapless is checked on the way."""
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {k: sum(r["size"] for r in own) for k, own in by.items()}


def test_sharding(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, "é" * rng.choice([0, 3, 40, 400]), "clash", 1.0) for i in range(3000)] + [(None, "copy of a hot text", "clash", 1.0)] * 900 + [(7, None, "clash", 1.0), (7, "", "clash", 1.0)]
    rows = sharding.shard_documents(frame(spark, docs), str(tmp_path / "map"), shards=8, slots=1024).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    size = shards_of(rows)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= max(0.001 * sum(size.values()) / 8, 64 * 40)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) > 1  # a hot group of equal rows is spread
    assert sharding.shard_documents(frame(spark, []), str(tmp_path / "none")).count() == 0


def test_slot_map_versions(spark, tmp_path):
    """A further shard takes slots only into itself; fewer shards move only what they lose; versions aren't overwritten."""
    rng = np.random.default_rng(2)
    size = rng.integers(0, 1000, 512)
    size[5] = 10**6  # a slot that outweighs all others
    one = sharding.rebalanced(sharding.first_map(512, 8), size, 8)
    load = np.bincount(one, size, 8)
    others = np.delete(load, one[5])
    assert others.max() - others.min() <= 1000 and (size[one == one[5]] > 0).sum() == 1
    size[5] = 0
    even = sharding.rebalanced(one, size, 8)
    nine = sharding.rebalanced(even, size, 9)
    load = np.bincount(nine, size, 9)
    assert load.max() - load.min() <= 0.02 * size.sum() / 9 and (nine[nine != even] == 8).mean() > 0.8 and (nine != even).mean() < 0.25
    seven = sharding.rebalanced(even, size, 7)
    assert seven.max() == 6 and np.bincount(seven, size, 7).max() <= 1.01 * size.sum() / 7 and (seven[even < 7] != even[even < 7]).mean() < 0.1
    folder = str(tmp_path / "map")
    for version, to in enumerate([one, nine]):
        sharding.save_map(spark, folder, version, to, size)
    assert (sharding.read_map(spark, folder, 0) == one).all() and (sharding.read_map(spark, folder, 1) == nine).all()
    with pytest.raises(AnalysisException):
        sharding.save_map(spark, folder, 1, one, size)


def test_sharding_of_later_versions(spark, tmp_path):
    """Documents that come later are placed by the next version of the stored map, with one shard more."""
    docs = [(i, "x" * (i % 50), "", 0.0) for i in range(500)]
    first = {r["doc_id"]: r["virtual_slot"] for r in sharding.shard_documents(frame(spark, docs), str(tmp_path / "m"), shards=4, slots=256).collect()}
    again = sharding.shard_documents(frame(spark, docs + [(1000 + i, "y" * 30, "", 0.0) for i in range(200)]), str(tmp_path / "m"), shards=5, slots=256, version=2).collect()
    assert set(shards_of(again)) == set(range(5)) and all(first[r["doc_id"]] == r["virtual_slot"] for r in again if r["doc_id"] < 1000)


def near(a, b):
    """Does one insertion, deletion or replacement make a word the other?"""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[a-z\u00c0-\u00ff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        beside = sorted((-n[x], x) for x in n if near(w, x))
        out[w] = [beside[0][1] if beside and -beside[0][0] >= 2 * n[w] else None, n[w], len(beside)]

    def last(w):
        return w if out[w][0] is None else last(out[w][0])

    return {(w, form, last(w), k, m, None if form is None else n[form]) for w, (form, k, m) in out.items()}


@pytest.mark.parametrize("most", [2, 5, 128])
def test_variants(spark, most):
    """Blocks of any bound find the same: small bounds subdivide almost every block, to the last code point."""
    rng = random.Random(most)
    bases = ["banana", "aaaaaaa", "spelling", "élèveÿ", "a" * 40, "abcabcabcabc", "Bananas", "spélling"]
    words = list(bases)
    for w in bases * 12:
        at = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:at] + rng.choice("abxé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abxÉ") + w[at + 1 :]]))
    words += ["".join(p) for p in itertools.islice(itertools.product("ab", repeat=6), 64)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=60)) + rng.choice(["", "_1", "\n"])) for i in range(90)]
    docs += [(None, "banana banana Banana"), (5, None), (5, ""), (5, "1 2 3"), (5, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 30_000), (6, "y" * 29_999 + " " + "x" * 29_999)] + [(9, "x" * 29_999)] * 3
    got = spelling.variants(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string"), most).collect()
    assert Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got) == Counter(slow_variants(docs))
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_blocks_are_bounded(spark):
    """One prefix that all words share is subdivided until blocks are small, and each pair has one block of its own."""
    words = ["prefix" + "".join(p) + "suffix" for p in itertools.product("abcdef", repeat=4)]
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    dealt = spelling.blocks(rows, 16)
    open_ = dealt.where("m - a - c > 1").groupBy(*spelling.BLOCK).count()
    assert open_.agg(F.max("count")).first()[0] <= 16 and dealt.groupBy(*spelling.BLOCK).count().agg(F.max("count")).first()[0] <= 90
    got = spelling.near_words(rows, 16).collect()
    assert len(got) == len(words) and all(r["n_near"] == 4 * 5 for r in got)


def slow_clusters(vectors, k, rounds):
    """All distances in plain integers."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, at, strict=True)), j) for j, at in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in vectors]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(vectors, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in vectors), c


@pytest.mark.parametrize("spread", [0.01, 0.5, 3000.0])
def test_clusters(spark, spread):
    """Many ties at a small spread; sums beyond the exact range of doubles at a large one."""
    rng = random.Random(3)
    rows = [(i, [spread * rng.choice([-1, 0, 1, rng.gauss(0, 1)]) if j < 6 else 0.0 for j in range(64)]) for i in range(260)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got, c = centroids.cluster(vectors, centroids.first_centroids(vectors))
    want, mid = slow_clusters(whole, 40, 5)
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in got.collect()) == want and c.tolist() == mid


def test_few_vectors(spark):
    rows = [(1, [0.1] * 64), (1, [0.1] * 64), (None, [0.2] * 64)]
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got, c = centroids.cluster(vectors, centroids.first_centroids(vectors))
    assert len(c) == 3 and [r["distance"] for r in got.collect()] == [0, 0, 0] and len({r["cluster"] for r in got.collect()}) == 2
    none = vectors.limit(0)
    assert centroids.cluster(none, centroids.first_centroids(none))[0].count() == 0


def test_ball_search_tries_few():
    """Well separated groups: after the first round most vectors are settled by their bounds, and others try few centroids."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-5000, 5000, (40, 64))
    x = np.repeat(middles, 50, axis=0) + rng.integers(-60, 60, (2000, 64))
    ball = centroids.Ball(middles + 7)
    own, upper, lower = np.repeat(np.arange(40), 50), np.full(2000, np.inf), np.zeros(2000)
    assert ball.assign(x, own, upper, lower) == 2000 and (own == np.repeat(np.arange(40), 50)).all()
    again = centroids.Ball(middles, middles + 7)
    assert again.assign(x, own, upper, lower) == 0
    lost = np.full(2000, 3)  # from a wrong centroid the ball reaches far enough
    upper[:] = np.inf
    lower[:] = 0
    again.assign(x, lost, upper, lower)
    assert (lost == own).all()
