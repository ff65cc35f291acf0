"""Near-duplicates, line dedup, components and the pipeline against brute force."""

import collections
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talentlake.llm import common, line_dedup, near_dup
from talentlake.llm.components import components
from talentlake.operators import shared


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    want = roots({n for link in links if link[0] != link[1] for n in link}, links)
    assert {r["node"]: r["label"] for r in components(frame(links)).collect()} == want
    assert {r["node"]: r["label"] for r in components(frame(links[30:]), components(frame(links[:30]))).collect()} == want
    assert components(frame([])).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    return sets, roots(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    docs, passage = [], rng.choices(words, k=40)
    for base in range(6):
        text = rng.choices(words, k=90)
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += [" ".join([*passage, *rng.choices(words, k=rng.randrange(4, 30))]) for _ in range(40)]
    docs += docs[:5] + ["", None, " \n", "One", "one", "two", "a b", "A  b", "x y z w " * 3000]
    return list(enumerate(docs))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    docs = corpus(random.Random(7))
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, class string, node double")
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(frame, near_dup.Plan(shingle=k)).collect()}
    sets, want = brute(docs, k)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["kept"] == (want[i] == i) for i, r in got.items())


def test_blocks(spark):
    """All links of a crowded cluster by blocks, against brute force."""
    import numpy as np

    rng, plan = random.Random(3), near_dup.Plan()
    base = list(range(60))
    sets = [(i, sorted({*rng.sample(base, rng.randrange(48, 60)), 1000 + i})) for i in range(120)]
    hashes = near_dup.Hashes(plan.size)
    sign = lambda s: bytearray(hashes.signature(np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tobytes())
    nodes = spark.createDataFrame([(i, i, 0, sign(s)) for i, s in sets], "node long, label long, cluster long, signature binary")
    links = near_dup.block_links(nodes, spark.createDataFrame(sets, "node long, members array<long>"), plan, rows=25).collect()
    want = roots(range(120), [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})])
    assert roots(range(120), [(r["a"], r["b"]) for r in links]) == want and len(set(want.values())) > 1


def test_crowds(spark):
    """Documents that share most of a passage, below the similarity, so that buckets hold many components: hubs alone don't link them."""
    rng = random.Random(23)
    words = [f"w{k}" for k in range(3000)]
    passage, docs = rng.choices(words, k=60), []
    for _ in range(60):
        own = rng.choices(words, k=12)
        docs += [" ".join(passage + own)] + [" ".join([*passage, *own, *rng.choices(words, k=rng.randrange(1, 4))]) for _ in range(2)]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame, near_dup.Plan(shingle=2)).collect()}
    want = brute(docs, 2)[1]
    assert got == want and 1 < len(set(want.values())) < 180


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "same text here now ok"), (None, "same text here now ok"), (4, "same text here now ok"), (4, "same text here now ok"), (9, "same text here now ok"), (5, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(4, 4, True), (4, 4, True), (5, 5, True), (9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_one_document(spark):
    """Rows of one doc_id with different texts are judged each by its own; doc_id may be a string."""
    one, two = (" ".join(f"{x}{k}" for k in range(40)) for x in "pq")
    rows = [("d1", one), ("d1", two), ("d2", one + " more"), ("d3", two + " more"), ("d4", "else")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [("d1", "d1", True), ("d1", "d1", True), ("d2", "d1", False), ("d3", "d1", False), ("d4", "d4", True)]


def test_one_row_for_each_group(spark):
    """Rows of one doc_id in different groups, of which one is another's copy; repeated rows; near copies under one doc_id."""
    words = lambda x, n=40: " ".join(f"{x}{k}" for k in range(n))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a, "s1"), (2, a, "s2"), (2, b, "s3"), (3, b + " more", "s4"), (3, b + " more", "s4"), (4, c, "z"), (4, c, "y"), (4, c + " end", "x"), (5, c, "w"), (None, a, "n"), (None, a, "n"), (6, "", "e"), (7, None, "e"), (7, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = near_dup.without_duplicates(docs).collect()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in got)
    four = [(r["text"], r["source"]) for r in got if r["doc_id"] == 4]
    assert four in ([(c, "y")], [(c + " end", "x")])
    assert texts == collections.Counter([(1, a), (2, b), (4, four[0][0]), (None, a), (None, a), (6, ""), (7, None), (7, None)])
    assert near_dup.without_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole():
    """Signatures within the distance always share an entry."""
    import numpy as np
    from itertools import combinations

    plan, rng = near_dup.Plan(), np.random.default_rng(1)
    for _ in range(200):
        wrong = set(rng.choice(plan.size, plan.distance, replace=False).tolist())
        spared = [c for c in range(plan.chunks) if sum(c * plan.width + k in wrong for k in range(plan.width)) <= plan.errors]
        assert spared
    assert len(list(combinations(range(plan.width), plan.errors))) * plan.chunks == plan.size


LONG = "this line has quite a few words of its own so that nothing like it recurs by chance here at all {}"


def test_lines(spark):
    line = lambda k: LONG.format(k)
    docs = [
        (1, "\n".join([line(1), line(2), "", "short", line(3)])),
        (2, "\n".join(["intro", line(1), line(2), "", "short", line(9)])),  # a block with short lines in it
        (3, "\n".join([line(3), "between", line(1)])),  # blocks that moved
        (4, "short\n\nother"),  # short lines alone stay
        (5, "\n".join([line(9), line(9)])),  # twice what 2 has once
        (6, None), (7, ""), (8, "\n".join([line(7), line(7)])),  # repeats within one document stay
        (None, line(1)), (9, line(1)), (9, line(1)),
    ]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_removed int")
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(frame).collect():
        got[r["doc_id"]].append((r["text"], r["n_removed"]))
    assert got[1] == [(docs[0][1], 0)] and got[2] == [("intro\n" + line(9), 4)] and got[3] == [("between", 2)] and got[4] == [("short\n\nother", 0)]
    assert got[5] == [("", 2)] and got[6] == [(None, 0)] and got[7] == [("", 0)] and got[8] == [(docs[7][1], 0)] and got[None] == [(line(1), 0)] and got[9] == [("", 1)] * 2
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_lines_against_brute_force(spark):
    """No long line is left in two documents where an earlier one has it; every line is left somewhere."""
    rng = random.Random(11)
    pool = [LONG.format(k) for k in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else LONG.format(f"{i}-{j}") for j in range(rng.randrange(1, 12)))) for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        for x in t.split("\n"):
            first.setdefault(x, i)
    assert got == {i: "\n".join(x for x in t.split("\n") if first[x] == i) for i, t in docs}


def test_blocks_of_any_earlier_document(spark):
    """What goes are the lines of all blocks of enough words that any earlier document holds, whatever the lines' lengths and first holders."""
    twelve = lambda k: " ".join(f"{k}w{i}" for i in range(12))
    verse = "\n".join(f"verse {k} short line" for k in range(13))
    docs = [(1, twelve("a")), (2, twelve("b")), (3, f"{twelve('a')}\n{twelve('b')}"), (4, f"{twelve('a')}\n{twelve('b')}"), (5, verse), (6, f"{verse}\nend")]
    rng = random.Random(3)
    pool = [" ".join(f"{k}v{i}" for i in range(rng.choice([0, 1, 3, 4, 7, 12, 25]))) for k in range(14)]
    docs += [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(10, 90)]
    want = {}
    for n, (i, t) in enumerate(docs):
        b, gone = t.split("\n"), set()
        for _, other in docs[:n]:
            a = other.split("\n")
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    if sum(len(z.split()) for z in b[y : y + k]) >= 20:
                        gone.update(range(y, y + k))
        want[i] = "\n".join(z for y, z in enumerate(b) if y not in gone)
    assert want[3] == docs[2][1] and want[4] == "" and want[6] == "end"
    assert want == {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_passage_of_short_lines(spark):
    """A passage of which no line reaches min_line words goes, if it has min_block words; a shorter one stays."""
    verse = "\n".join(f"verse {k} of four" for k in range(5))
    docs = [(1, f"start\n{verse}"), (2, f"{verse}\nend"), (3, "\n".join(verse.split("\n")[:4]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "end", 3: docs[2][1]}


def test_patience():
    a, b = list("abcdefgh"), list("xabcyfghz")
    assert line_dedup.patience([ord(c) for c in a], [ord(c) for c in b]) == {1: 0, 2: 1, 3: 2, 5: 5, 6: 6, 7: 7}
    assert line_dedup.removable([1, 2, 3], [3, 1, 2], [9, 9, 9], 10) == [1, 2]


def test_alignment_decides(monkeypatch):
    """Blocks that cross, insertions within a block, and copies: what goes are the aligned blocks, and without an alignment nothing does."""
    rng = random.Random(9)
    size = {x: rng.choice([0, 2, 6, 11, 25]) for x in range(1, 13)}
    cases = []
    for _ in range(3000):
        a, b = ([rng.randrange(1, 13) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        if rng.random() < 0.5:  # b is a with blocks exchanged, a line put in and one repeated
            cut = sorted(rng.randrange(len(a) + 1) for _ in range(2))
            b = a[cut[0] : cut[1]] + a[: cut[0]] + [rng.randrange(1, 13)] + a[cut[1] :] + a[:1]
        words = [size[x] for x in b]
        gone = set()
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                    k += 1
                if sum(words[y : y + k]) >= 20:
                    gone.update(range(y, y + k))
        cases.append((a, b, words, sorted(gone)))
    assert all(sorted(line_dedup.removable(a, b, w, 20)) == gone for a, b, w, gone in cases) and sum(bool(c[3]) for c in cases) > 500
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: {})
    assert not any(line_dedup.removable(a, b, w, 20) for a, b, w, _ in cases)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    say = {"aa": [f"al{k}pha" for k in range(90)], "bb": [f"uno{k}dos" for k in range(90)]}
    text = lambda lang, n=60: " ".join("".join(c for c in w if not c.isdigit()) + "xyzuvw"[k % 6] * (k % 4) for k, w in enumerate(rng.choices(say[lang], k=n)))
    words = lambda n, lang: " ".join("".join(rng.choices("abcde" if lang == "aa" else "uvwxy", k=7)) for _ in range(n))
    del text
    docs = [(k, words(60, lang), lang, "s", 0) for k, lang in enumerate(["aa", "bb"] * 20)]
    bench = words(30, "aa")
    near = docs[3][1].rsplit(" ", 2)[0] + " uvwxyuv yxwvuxy"
    docs += [(100, docs[0][1], "aa", "s", 0), (101, near, "bb", "s", 0), (102, f"{words(20, 'aa')} {bench.upper()} {words(20, 'aa')}", "aa", "s", 0), (103, None, "aa", "s", 0), (104, "123", "aa", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe_codec"]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == {*range(40), 102}  # the copy, the near copy, the null and the letterless text are gone
    assert all(rows[i]["text"] == t for i, t, *_ in docs[:40]) and bench.upper() not in rows[102]["text"]
    assert len(rows[102]["text"].split()) == 40 and all(len(r["token_ids"]) == r["n_tokens"] and r["n_chars"] == len(r["text"]) for r in rows.values())


def test_written_tables_leave_no_shuffle_files(spark):
    """Tables on the way: once one is written, the disk no longer holds what was shuffled for it; it reads the same, and so does its source."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    rows = spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("n")).repartition(7, "n")
    for written in (common.written, shared.written):
        before = shuffled()
        made = written(rows)
        for _ in range(50):  # the files are removed in the background
            if shuffled() <= before:
                break
            time.sleep(0.2)
        assert shuffled() <= before and spark.conf.get(shared.CLEANUP, "false") == "false"
        assert sorted(made.collect()) == sorted(rows.collect())
