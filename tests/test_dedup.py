"""Greedy dedup against a row-by-row replay, and the similarity join against all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.functions.text import fingerprint
from talentlake.plans import dedup


def replay(rows, threshold=0.9):
    """Accepted rows in order, remembering only those."""
    kept, out = [], {}
    for seq, h, url, fp, key, tokens in rows:
        verdict = None
        for layer, k, confidence in (("layer1_hash", 1, 1.0), ("layer5_url", 2, 0.98), ("layer2_fingerprint", 3, 0.95), ("layer4_alias", 4, 0.9)):
            mine = (seq, h, url, fp, key)[k]
            hit = next((r for r in kept if mine and r[k] == mine), None)
            if hit:
                verdict = (layer, confidence, hit[0])
                break
        if not verdict and fp:
            best = None
            for r in kept:
                if r[3] and (score := len(set(tokens) & set(r[5])) / len(set(tokens) | set(r[5]))) >= threshold and (best is None or score > best[0]):
                    best = (score, r[0])
            if best:
                verdict = ("layer3_semantic", round(best[0], 4), best[1])
        out[seq] = verdict
        if not verdict:
            kept.append((seq, h, url, fp, key, tokens))
    return out


def postings(spark, raw):
    """Jobs of (seq, hash, url, role, description); the description's words are the tokens, as the role is no word of theirs."""
    df = spark.createDataFrame(raw, "seq long, job_hash string, url string, role string, description string")
    return df.select(
        "seq", "job_hash", F.concat(F.lit("x.com/"), "url").alias("url"), F.lit("c").alias("company_name"), F.lit(None).cast("string").alias("canonical_company_name"), "role",
        F.lit(None).cast("string").alias("normalized_role"), "description", F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country")).alias("location"),
        fingerprint(F.col("role"), F.col("description")).alias("content_fingerprint"),
    )


def keyed(raw):
    """The rows of ``replay``: role and description make the tokens, and their set the fingerprint."""
    out = []
    for s, h, u, r, d in raw:
        tokens = sorted({w for w in f"{r} {d or ''}".lower().split() if len(w) > 1})
        out.append((s, h, f"x.com/{u}" if u else None, " ".join(tokens) or None, f"c|{r}||", tokens))
    return out


@pytest.mark.parametrize("crowd", [50_000, 30, 0])
def test_replay(spark, crowd):
    """Components replayed, crowded ones in rounds, or all of them in rounds: the same verdicts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(26)]
    raw = []
    for seq in range(160):
        base = rng.randrange(14)
        tokens = [w for k, w in enumerate(words) if (k + base) % 13 < 11]
        if rng.random() < 0.5:
            tokens = tokens[:-1]
        raw.append((seq, f"h{rng.randrange(110)}", rng.choice([None, f"u{rng.randrange(110)}"]), f"r{rng.randrange(120)}", " ".join(tokens) if rng.random() < 0.9 else None))
    got = {r["seq"]: (r["layer"], r["confidence"], r["matched_seq"]) if r["is_duplicate"] else None for r in dedup.deduplicate(postings(spark, raw), crowd=crowd).collect()}
    assert got == replay(keyed(raw))


def replay_mixed(rows, threshold=0.9):
    """As ``replay``, with a vector at the end of each row: cosine where both have one, else Jaccard."""
    kept, out = [], {}
    for seq, h, url, fp, key, tokens, v in rows:
        verdict = None
        for layer, k, confidence in (("layer1_hash", 1, 1.0), ("layer5_url", 2, 0.98), ("layer2_fingerprint", 3, 0.95), ("layer4_alias", 4, 0.9)):
            mine = (seq, h, url, fp, key)[k]
            hit = next((r for r in kept if mine and r[k] == mine), None)
            if hit:
                verdict = (layer, confidence, hit[0])
                break
        best = None
        for r in kept if not verdict else ():
            if v and r[6]:
                score = 0.0
                if len(v) == len(r[6]) and any(v) and any(r[6]):
                    score = 1.0 if v == r[6] else round(float(np.dot(v, r[6]) / np.sqrt(np.dot(v, v) * np.dot(r[6], r[6]))), 12)
            else:
                score = len(set(tokens) & set(r[5])) / len(set(tokens) | set(r[5])) if tokens and r[5] else 0.0
            if score >= threshold and (best is None or score > best[0]):
                best = (score, r[0])
        if best:
            verdict = ("layer3_semantic", round(best[0], 4), best[1])
        out[seq] = verdict
        if not verdict:
            kept.append((seq, h, url, fp, key, tokens, v))
    return out


@pytest.mark.parametrize(("crowd", "share"), [(50_000, 0.5), (25, 0.5), (0, 1.0)])
def test_vectors(spark, crowd, share):
    """Rows with and without vectors, equal and similar ones, other lengths, zeros and rows without tokens, against the replay."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(26)]
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(15)]
    raw, vectors = [], []
    for seq in range(170):
        base = rng.randrange(14)
        tokens = [w for k, w in enumerate(words) if (k + base) % 13 < 11][: rng.choice([22, 22, 21])]
        raw.append((seq, f"h{seq if rng.random() < 0.9 else rng.randrange(seq + 1)}", rng.choice([None, f"u{rng.randrange(400)}"]), f"r{rng.randrange(300)}", " ".join(tokens) + f" x{seq // 4}" if rng.random() < 0.8 else None))
        near = [x + rng.choice([0, 0.1, 0.3]) * rng.gauss(0, 1) for x in rng.choice(middles)]
        vectors.append(rng.choice([near, near, near, middles[0], [0.0] * 8, [1.0, 2.0], [2.0, 4.1]]) if rng.random() < share else rng.choice([None, []]))
    rows = postings(spark, raw).join(spark.createDataFrame(list(enumerate(vectors)), "seq long, embedding array<double>"), "seq")
    got = {r["seq"]: (r["layer"], r["confidence"], r["matched_seq"]) if r["is_duplicate"] else None for r in dedup.deduplicate(rows, crowd=crowd).collect()}
    want = replay_mixed([(*k, v) for k, v in zip(keyed(raw), vectors, strict=True)])
    assert got == want and (not share or sum(v is not None and v[0] == "layer3_semantic" for v in want.values()) > 20)


def test_encoder(spark):
    """Vectors made for rows that have none: similar by hashed tokens, where Jaccard alone would not do."""
    from talentlake.functions.vectors import hash_embedding

    said = " ".join(f"w{k}" for k in range(20))
    raw = [(0, "a", "1", "r1", said), (1, "b", "2", "r2", said + " more"), (2, "c", "3", "r3", "quite something else")]
    plain = {r["seq"]: r["layer"] for r in dedup.deduplicate(postings(spark, raw), 0.93).collect()}
    made = {r["seq"]: r["layer"] for r in dedup.deduplicate(postings(spark, raw), 0.93, encoder=lambda t: hash_embedding(t, 64)).collect()}
    assert plain == {0: None, 1: None, 2: None} and made == {0: None, 1: "layer3_semantic", 2: None}


def test_chain(spark):
    """A chain of 2,000 postings, each like the one before under another key: every second one is accepted."""
    raw = [(k, f"h{k // 2}", f"u{(k + 1) // 2}", f"r{k}", f"only{k}") for k in range(2000)]
    got = {r["seq"]: r["matched_seq"] for r in dedup.deduplicate(postings(spark, raw)).collect()}
    assert got == {k: None if k % 2 == 0 else k - 1 for k in range(2000)}


def test_first_rows_settle_most(spark):
    """Where all rows share few keys, the first ones settle the rest, and none is left for components."""
    raw = [(k, f"h{k}", f"u{k % 7}", f"r{k}", f"only{k}") for k in range(300)]
    rows = dedup.marked(dedup.records(postings(spark, raw)), None).select("seq", *dedup.KEYS, "bare", "clothed", "tokens")
    left, done = dedup._led(rows, None, None, 0.9, 20)
    assert left.isEmpty() and sorted(r["seq"] for r in done.collect()) == list(range(7))


def test_similar_sets(spark):
    rng = random.Random(2)
    sets = [(k, sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))})) for k in range(150)] + [(999, [])]
    got = {(r["a"], r["b"]) for r in dedup.similar_sets(spark.createDataFrame(sets, "id long, tokens array<string>"), 0.8).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    assert got == want


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.5])
def test_similar_sets_of_frequent_tokens(spark, threshold):
    """Sets of a small vocabulary, equal ones among them: all pairs are found, and few others are looked at."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(90)]
    sets = [rng.sample(words, rng.randrange(1, 70)) for _ in range(300)]
    sets += [[w for w in x if rng.random() < 0.97] or x for x in sets[:150]] + sets[:9]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b): s for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if (s := like(x, y)) >= threshold}
    assert {(r["a"], r["b"]): r["score"] for r in dedup.similar_sets(frame, threshold).collect()} == want
    if threshold == 0.9:
        met = dedup.part_keys(frame, threshold).groupBy("class", "key").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
        assert len(want) > 100 and met < 40 * len(want) < len(sets) ** 2 / 2


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, tokens array<string>")
    assert dedup.similar_sets(empty).count() == 0


def test_near_dup_jaccard(spark, tmp_path):
    """All documents take part: every pair of similar texts follows from classes and pairs of classes."""
    from talentlake.queries import QUERIES

    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(2, 40))) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], word()]) for t in texts[:40]] + [t.upper() + " the" for t in texts[20:50]]
    rng.shuffle(texts)
    docs = [*enumerate([*texts, None, "", "a the !", "a the !"], 600), (None, texts[0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: frozenset(w for w in t.lower().split() if w != "the") for i, t in docs[: len(texts)]}
    like = lambda x, y: len(x & y) / len(x | y)
    want = {(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and like(x, y) >= 0.9}
    rows = [tuple(r) for r in QUERIES["near_dup_jaccard"](spark, str(tmp_path)).select("a", "b", "score").collect()]
    assert len(rows) == len(set(rows)) and all(round(like(sets[a], sets[b]), 6) == s for a, b, s in rows)
    of = {i: i for i in sets} | {b: a for a, b, s in rows if s == 1}
    paired = {(a, b) for a, b, s in rows if s < 1}
    assert paired and {(i, j) for i in sets for j in sets if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in paired)} == want


def test_similar_sets_as_text(spark):
    """Sets that move as one text each give the same pairs, empty sets none, and both sides of a join are shuffled once."""
    rng = random.Random(23)
    words = [f"w{k}" for k in range(60)]
    sets = [rng.sample(words, rng.randrange(1, 50)) for _ in range(120)]
    sets += [[w for w in x if rng.random() < 0.96] for x in sets] + [[], []]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    shuffled = lambda: max((int(m.group(1)) for d in dirs() for f in Path(d.getPath()).rglob("shuffle_*") if (m := re.match(r"shuffle_(\d+)_", f.name))), default=-1)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs
    want = sorted(map(tuple, dedup.similar_sets(frame, 0.8).collect()))
    found = dedup.similar_sets(frame, 0.8, separator=" ")
    before = shuffled()
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    assert shuffled() == before  # what is compared leaves no shuffle of whole sets to the reader


def test_links_of_some_vectors(spark):
    """Two rows that are alike stay linked when a third one, which joins them in the forest of all vectors, is settled before."""
    angles = [0.0, 0.3, 0.15, 3.0, 3.3, 3.15]
    given = [(k, f"h{k}", str(k), f"r{k}", None, [float(np.cos(a)), float(np.sin(a)), 0.0]) for k, a in enumerate(angles)]
    jobs = postings(spark, [g[:5] for g in given]).join(spark.createDataFrame([(g[0], g[5]) for g in given], "seq long, embedding array<double>"), "seq")
    every = dedup.coded(dedup.records(jobs)).localCheckpoint()
    found = every.groupBy(F.col("vec").alias("cid")).agg(F.min("vector").alias("v"), F.count("*").alias("copies"))
    for gone in range(3):
        left = every.where(f"seq NOT IN ({gone}, {gone + 3})").drop("vector")
        linked = {frozenset(r) for r in dedup.links(left, found, 0.9).select("a", "b").collect() if r["a"] != r["b"]}
        pairs = [p for p in ([0, 1], [0, 2], [1, 2]) if gone not in p]
        assert linked == {frozenset(p) for p in pairs} | {frozenset([a + 3, b + 3]) for a, b in pairs}


def test_vectors_are_coded(spark):
    """Equal vectors have one code, whatever the sign of a zero; what has no direction has none."""
    raw = [(0, [1.0, 0.0]), (1, [1.0, -0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, float("nan")]), (7, [float("inf"), 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0])]
    rows = dedup.coded(spark.createDataFrame(raw, "seq long, vector array<double>").withColumn("fingerprint", F.lit("f")))
    got = {r["seq"]: (r["vec"], r["bare"], r["clothed"]) for r in rows.collect()}
    assert got[0][0] == got[1][0] and len({got[k][0] for k in (0, 2, 9)}) == 3
    assert [k for k in got if got[k][0] is None] == [3, 4, 5, 6, 7, 8] and got[3][1:] == ("f", None) and got[5][1:] == (None, "f")
