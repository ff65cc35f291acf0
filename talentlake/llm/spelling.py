"""Operator 12: grouping of spelling variants through forward and reversed sorted dictionaries.

Two words that differ by one inserted, deleted or replaced code point agree in their first half or in their second: with m the length of
the shorter one, either the first m // 2 code points stand at the start of both, or the rest of them at the end of both.  So the words are
dealt into blocks of a shared prefix (a range of the sorted dictionary) and blocks of a shared
suffix (a range of the dictionary sorted by the reversed words).  A block with more than ``MOST`` words is subdivided by the same argument: what
is uncertain between its prefix and its suffix is halved, and a pair agrees in one half or the other.  Within a pair's blocks exactly one
is the pair's own, by the length of its common prefix, so that no pair is found twice and nothing is made distinct.  The halving ends when one code
point is uncertain; such a block holds no more words than there are letters, of each of its two lengths.  Blocks are then
sorted within partitions and scanned, and each block's words are verified against each other in one array comparison.

What leaves a block is one row a word (its near words' number and the best of them), never a row a pair.  Roots are found by
doubling pointers; a form has at least twice the occurrences of its word, so chains are as short as the logarithm of the largest count.

Defined results: a null text has no words; a null doc_id counts as the empty text before the colon; repeated rows count each time;
ties go to the smaller word in code-point order; very long runs are words like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import parts_of, release, table, written

_RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY = 5, 3, 97
#: Blocks of more words are subdivided.
MOST = 128
#: Distinct words that a task holds before it passes on what it has counted.
HELD = 200_000
BLOCK = ("m", "a", "c", "hi", "key")


def typed_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with their numbers of occurrences.  Of one run in 97, by hash, a code point is lost."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for b in parts_of(whole, [1], 64, 1_000_000):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    start = zlib.crc32(f"{doc_id}:".encode())
                    # bytes lower-case ASCII letters only
                    for w, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                        h = zlib.crc32(w.encode(), start)
                        if h % DROP_EVERY == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= LEAST_LENGTH:
                            counts[w] += n
                if len(counts) >= HELD:
                    yield counted()
                    counts.clear()
        yield counted()
        counts.clear()
        release()

    found = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def halves(words: DataFrame) -> DataFrame:
    """Each word in its blocks: as the shorter or an equally long one (m is its length) and as the longer one, by prefix and by suffix.

    A block (m, a, c, hi, key) holds words of m and m + 1 code points with the same first ``a`` and last ``c``; its own
    are the pairs whose common prefix is shorter than ``hi``.
    """
    n = F.char_length("word")
    sized = words.withColumn("m", F.explode(F.array(n, n - 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(half.alias("a"), F.lit(0).alias("c"), F.lit(1 << 30).alias("hi")), F.struct(F.lit(0).alias("a"), (F.col("m") - half).alias("c"), half.alias("hi")))
    return _keyed(sized.withColumn("b", F.explode(sides)).select("word", "n", "m", "b.a", "b.c", "b.hi"))


def _keyed(rows: DataFrame) -> DataFrame:
    key = F.concat(F.substring("word", 1, F.col("a")), F.lit("|"), F.when(F.col("c") > 0, F.substring(F.col("word"), -F.col("c"), F.col("c"))).otherwise(""))
    return rows.withColumn("key", key).select("word", "n", *BLOCK)


def subdivided(rows: DataFrame) -> DataFrame:
    """The rows of blocks in which more than one code point is uncertain, in the two blocks that share half of what was."""
    j = F.floor((F.col("m") - F.col("a") - F.col("c")) / 2).cast("int")
    rest = F.col("m") - F.col("a") - j
    sides = F.array(F.struct((F.col("a") + j).alias("a"), F.col("c").alias("c"), F.col("hi").alias("hi")), F.struct(F.col("a").alias("a"), rest.alias("c"), F.least(F.col("hi"), F.col("a") + j).alias("hi")))
    return _keyed(rows.withColumn("b", F.explode(sides)).select("word", "n", "m", "b.a", "b.c", "b.hi"))


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """All words in blocks of at most ``most`` words, or of one uncertain code point."""
    rows, done = halves(words), None
    while True:
        # written, so that the join that follows may split a block that very many words share
        crowded = written(rows.where(F.col("m") - F.col("a") - F.col("c") > 1).groupBy(*BLOCK).agg(F.count("*").alias("size")).where(F.col("size") > most).drop("size"))
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        settled = rows.join(crowded, list(BLOCK), "left_anti").select("word", "n", *BLOCK)
        done = settled if done is None else done.unionByName(settled)
        rows = written(subdivided(rows.join(crowded, list(BLOCK), "left_semi")))


def near(words: list[str], m: int, a: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of a block that differ by one code point and whose common prefix is shorter than ``hi``, some rows at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(sizes == m), np.flatnonzero(sizes == m + 1)
    codes = lambda at, n: np.array([words[k] for k in at]).astype(f"U{n}").view(np.uint32).reshape(len(at), n)[:, a:] if len(at) else np.empty((0, n - a), np.uint32)
    x, y = codes(short, m), codes(long, m + 1)
    step = max(1, 2_000_000 // max(1, len(words) * (m - a + 1)))
    for k in range(0, len(short), step):
        part = x[k : k + step]
        same = part[:, None, :] == x[None, :, :]
        i, j = np.nonzero(same.sum(2) == m - a - 1)
        fits = (i + k < j) & (np.argmin(same[i, j], axis=1) + a < hi) if len(i) else np.zeros(0, bool)
        yield short[i[fits] + k], short[j[fits]]
        if len(long):
            ahead = np.logical_and.accumulate(part[:, None, :] == y[None, :, :-1], axis=2).sum(2)
            behind = np.logical_and.accumulate((part[:, None, :] == y[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
            i, j = np.nonzero((ahead + behind >= m - a) & (ahead + a < hi))
            yield short[i + k], long[j]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; a block ends where the next one begins, in whatever batch."""
    out: list[tuple[str, int, int, str]] = []
    block, words, counts = None, [], []

    def close() -> None:
        if len(words) < 2:
            return
        m, a, _, hi, _ = block
        found: dict[int, list] = {}
        for i, j in near(words, m, a, hi):
            for p, q in (*zip(i.tolist(), j.tolist(), strict=True), *zip(j.tolist(), i.tolist(), strict=True)):
                best = (-counts[q], words[q])
                seen = found.setdefault(p, [0, best])
                seen[0] += 1
                seen[1] = min(seen[1], best)
        out.extend((words[p], k, -best[0], best[1]) for p, (k, best) in found.items())

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    for b in batches:
        columns = [b.column(k).to_pylist() for k in range(7)]
        for word, n, *now in zip(*columns, strict=True):
            if now != block:
                close()
                block, words, counts = now, [], []
            words.append(word)
            counts.append(n)
        if len(out) > 10_000:
            yield batch()
    close()
    yield batch()
    release()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, best_n, best) of every word; best is the near word of most occurrences, null where none is near."""
    scanned = blocks(words, most).repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = scanned.mapInArrow(_scan, "word string, n_near long, best_n long, best string").withColumn("n", F.lit(None).cast("long"))
    own = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"), "n")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("best"))))
    named = found.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return named.select("word", "n", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, in rounds that double the way."""
    to = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = written(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if to.where("on").isEmpty():
            return to.select("word", "root")


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text)."""
    words = written(typed_words(docs))
    found = near_words(words, most)
    taken = F.col("best_n") >= 2 * F.col("n")
    found = written(found.select("word", F.when(taken, F.col("best")).alias("form"), "n", "n_near", F.when(taken, F.col("best_n")).alias("form_n")))
    roots = rooted(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
