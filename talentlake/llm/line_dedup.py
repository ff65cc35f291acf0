"""Operator 3: line dedup by pairwise alignment.

Lines long enough not to recur by chance are the rare lines.  Beside them stand runs: from each line on, and up to each line,
the shortest run of lines that reaches ``min_block`` words.  The first document of each line and run
is the one partner of every later document that holds it, so the number of pairs grows with the lines,
not with the square of a group, and no count of copies is too large to be seen.  Each
pair is aligned with patience diff (lines unique in both documents are anchors, the longest
increasing run of anchors is kept, equal neighbours join, gaps are aligned in turn;
anchors that cross it are blocks that moved, and further copies of a line align with its first), and aligned blocks of ``min_block`` words or more are
deleted from the later document; an aligned line counts for the longest block that any of its copies stands in.

That finds every block of ``min_block`` words or more that any earlier document holds: each of its lines lies in a run within the
block, whose first document is a partner.

Of every deleted block the earliest copy stays, as a document loses lines only to an earlier one.
Lines are compared by a 64-bit hash of their text without blanks at the ends, runs by a 61-bit hash of those.

Defined results: null text stays null and empty text empty; a row with a null doc_id is passed through;
rows of one doc_id are the same document and don't cost each other lines; ties can't occur, as doc_ids order the documents;
columns that clash with the added ones are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import add_columns, cut, table, written

BLANKS = " \t\n\x0b\x0c\r"
#: Modulus and base of the hash of runs.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def line_arrays(texts: list[str | None]) -> list[list]:
    """Per text: the hash of each line, and its number of words."""
    hashes, sizes = [], []
    for t in texts:
        lines = [x.strip(BLANKS).encode("utf-8", "surrogatepass") for x in (t or "").split("\n")]
        hashes.append([h - (1 << 64) if (h := xxhash.xxh64_intdigest(x)) >> 63 else h for x in lines])
        sizes.append([len(x.split()) for x in lines])
    return [hashes, sizes]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, in which the second grows too."""
    tails: list[int] = []
    at: list[int] = []
    back = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(b), at.append(k)
        else:
            tails[i], at[i] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _unique_common(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of the lines that occur once in either stretch."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {x: i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
    return [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]


def patience(a: list[int], b: list[int]) -> dict[int, int]:
    """Aligned places, of b to a, moved blocks included."""
    to: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            to[b0] = a0
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            to[b1] = a1
        anchors = _increasing(_unique_common(a, b, a0, a1, b0, b1)) if a0 < a1 and b0 < b1 else []
        for i, j in anchors:
            todo.append((a0, i, b0, j))
            to[j] = i
            a0, b0 = i + 1, j + 1
        if anchors:
            todo.append((a0, a1, b0, b1))
    used = set(to.values())
    for i, j in _unique_common(a, b, 0, len(a), 0, len(b)):  # what crosses the alignment has moved
        for step in (1, -1):
            x, y = (i, j) if step == 1 else (i - 1, j - 1)
            while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y] and y not in to and x not in used:
                to[y] = x
                used.add(x)
                x, y = x + step, y + step
    first = {x: i for i, x in reversed(list(enumerate(a)))}
    for j, x in enumerate(b):  # further copies of a line all stand for its first one, or go on from the line before
        if j not in to and x in first:
            follow = to.get(j - 1, len(a)) + 1
            to[j] = follow if follow < len(a) and a[follow] == x else first[x]
    return to


def run_keys(lines: list[int], words: list[int], min_block: int) -> dict[tuple[int, int], int]:
    """The hash of each shortest run of enough words from a line on or up to a line, by start and end."""
    n = len(lines)
    sums, sofar, power = [0], [0], [1]
    for x, w in zip(lines, words, strict=True):
        sums.append(sums[-1] + w)
        sofar.append((sofar[-1] * BASE + x) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    spans, j = set(), 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and sums[j] - sums[i] < min_block:
            j += 1
        if sums[j] - sums[i] < min_block:
            break
        spans.add((i, j))
    i = 0
    for j in range(1, n + 1):
        while i + 1 < j and sums[j] - sums[i + 1] >= min_block:
            i += 1
        if sums[j] - sums[i] >= min_block:
            spans.add((i, j))
    return {(i, j): (sofar[j] - sofar[i] * power[j - i]) % PRIME for i, j in spans}


def removable(a: list[int], b: list[int], words: list[int], min_block: int) -> list[int]:
    """Places in b that belong to aligned blocks of enough words.

    A line with several copies in a is aligned with one of them, though a block with another copy may be longer.  So aligned lines whose block
    is too short are tried again: runs of aligned lines that stand in a as well, anywhere, are blocks too.
    """
    to = patience(a, b)
    out, block = [], []
    for j in [*sorted(to), None]:
        if block and (j is None or j != block[-1] + 1 or to[j] != to[block[-1]] + 1):
            if sum(words[k] for k in block) >= min_block:
                out += block
            block = []
        block.append(j)
    sure = set(out)
    loose = [k in to and k not in sure for k in range(len(b))]
    if not any(loose):
        return out
    gaps = [0, *accumulate(k not in to for k in range(len(b)))]  # lines without a partner before each place
    open_ = [0, *accumulate(loose)]
    size = dict(zip(b, words, strict=True))
    held = set(run_keys(a, [size.get(x, min_block) for x in a], min_block).values())  # a run with a line that b lacks is in no case shared
    steps = [0] * (len(b) + 1)
    for (i, j), key in run_keys(b, words, min_block).items():
        if gaps[i] == gaps[j] and open_[i] < open_[j] and key in held:
            steps[i] += 1
            steps[j] -= 1
    return sorted({*out, *(k for k, n in enumerate(accumulate(steps)) if n)})


def removed_lines(docs: DataFrame, min_line: int = 5, min_block: int = 20) -> DataFrame:
    """(doc_id, removed): the places of the lines that a document loses, for documents that lose any."""
    def keyed(texts: list[str | None]) -> list[list]:
        lines, words = line_arrays(texts)
        keys = []
        for x, w in zip(lines, words, strict=True):
            rare = {h for h, k in zip(x, w, strict=True) if k >= min_line}
            keys.append(list(rare.union(key for (i, j), key in run_keys(x, w, min_block).items() if j - i > 1 or w[i] < min_line)))
        return [lines, words, keys]

    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    arrays = cut(add_columns(named, ["text"], "lines array<long>, words array<int>, keys array<long>", keyed).drop("text"))
    rare = arrays.select("doc_id", F.explode("keys").alias("line"))
    arrays = arrays.drop("keys")
    # written, so that a line that very many documents hold can be split when they are joined with it
    first = written(rare.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("line", "first"))
    pairs = rare.join(first, "line").where("doc_id > first").select("doc_id", "first").distinct()
    early = arrays.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines"))
    both = pairs.join(early, "first").join(arrays, "doc_id")

    def make(a: list, b: list, w: list) -> list[list]:
        return [[removable(*x, min_block) for x in zip(a, b, w, strict=True)]]

    found = add_columns(both, ["first_lines", "lines", "words"], "removed array<int>", make).where(F.size("removed") > 0)
    # a document has no more partners than lines
    return found.groupBy("doc_id", "lines").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def dedup_lines(docs: DataFrame, min_line: int = 5, min_block: int = 20) -> DataFrame:
    """``docs`` with its texts cleaned, and n_lines and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # rows that repeat a doc_id with another text have other lines; each row takes what was found for its own
    lost = removed_lines(docs, min_line, min_block).groupBy("doc_id").agg(F.collect_list(F.struct("lines", "removed")).alias("__lost"))

    def make(texts: list[str | None], lost: list) -> list[list]:
        out, n, gone = [], [], []
        for t, found in zip(texts, lost, strict=True):
            if found and len(found) > 1:
                own = line_arrays([t])[0][0]
                found = [x for x in found if x["lines"] == own]
            drop = set(found[0]["removed"]) if found and t is not None else set()
            parts = (t or "").split("\n")
            out.append("\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else t)
            n.append(len(parts) if t is not None else 0)
            gone.append(len(drop))
        return [out, n, gone]

    done = add_columns(docs.select(*kept).join(lost, "doc_id", "left"), ["text", "__lost"], "__text string, n_lines int, n_removed int", make)
    return done.withColumn("text", F.col("__text")).select(*kept, "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "text")
