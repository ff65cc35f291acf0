"""Operator 9: benchmark decontamination with an FM-index per training shard.

Each task gathers documents into shards of bounded size and builds, for each, an FM-index
over word numbers: suffix array, Burrows-Wheeler transform, a wavelet tree laid out level
by level with prefix counts, and sampled suffix positions.  All benchmark windows are
searched backward at once; the rows found walk to the nearest sampled position, and
their word ranges are merged into removal spans.  Documents are never shuffled.

Words outside the benchmark's vocabulary all share one number, and stretches of its
words that are shorter than the shortest window can't hold an occurrence, so a shard
indexes each such stretch as one symbol.  The benchmark is dealt into blocks of bounded size; more
blocks mean more passes over the documents, never a larger broadcast.

Defined results: null or empty text has no words and no hits; a null or empty item has no
window; an item with a null id is searched and cut, but not named; equal items each count by their id, rows that repeat
an id count once; repeated documents each keep their row; columns of ``documents`` that clash with the added ones are
replaced; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.llm.common import release, table

WINDOW = 10
#: The words of a text before its letters are lower-cased.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
END, DOCUMENT, OTHER, FIRST = 0, 1, 2, 3
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Sorts all suffixes by doubling; only groups still tied are sorted again.  ``t`` ends with its only END."""
    n, width = len(t), max(1, int(symbols - 1).bit_length())
    h = max(1, 62 // width)
    padded = np.concatenate([t.astype(np.int64), np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << width) | padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_ = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(open_):
        s = sa[open_]
        follow = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        key = rank[s] * np.int64(n + 1) + follow
        order = np.argsort(key)
        s, key = s[order], key[order]
        sa[open_] = s
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[s] = open_[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
        open_ = open_[~(head & np.concatenate([head[1:], [True]]))]
        h *= 2
    return sa


class FmIndex:
    """Backward search and locating over one shard."""

    def __init__(self, t: np.ndarray, symbols: int, sample: int = 8):
        sa = suffix_array(t, symbols)
        bwt = t[sa - 1]
        self.n = len(t)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))]).astype(np.int64)
        self.levels = list(range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1))
        self.ones, self.zeros, row = [], [], bwt
        for level in self.levels:
            bit = ((row >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])
        self.leaf = np.zeros(symbols, np.int64)  # where each symbol's run begins below the last level
        order, begin = np.unique(row, return_index=True)
        self.leaf[order] = begin
        marked = sa % sample == 0
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.sampled = sa[marked]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before row i of the transform."""
        for level, ones, zeros in zip(self.levels, self.ones, self.zeros, strict=True):
            one = ones[i]
            i = np.where((symbol >> level) & 1, zeros + one, i - one)
        return i - self.leaf[symbol]

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol, i = np.zeros(len(row), np.int64), row
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i]
            bit = ones[i + 1] - one
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + one, i - one)
        return self.first[symbol] + i - self.leaf[symbol]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (right-aligned rows of symbols) that occur: their numbers and row ranges."""
        live = np.arange(len(patterns))
        symbol = patterns[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        out = []
        for k in range(1, patterns.shape[1] + 1):
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            whole = sizes[live] == k
            out.append((live[whole], low[whole], high[whole]))
            live, low, high = live[~whole], low[~whole], high[~whole]
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - k]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin in the shard."""
        where, walked = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        left = np.arange(len(row))
        while len(left):
            there = self.marked[row]
            where[left[there]] = self.sampled[self.place[row[there]]] + walked[left[there]]
            left, row = left[~there], self.step(row[~there])
            walked[left] += 1
        return where


@dataclass
class Windows:
    """The distinct windows of a block of benchmark items."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    sizes: np.ndarray
    items: list[tuple[str, ...]]

    @classmethod
    def of(cls, rows: list[tuple], window: int = WINDOW) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + FIRST) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                names = found.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    names.add(str(item))
        patterns = np.full((len(found), window), OTHER, np.int64)
        for k, w in enumerate(found):
            patterns[k, window - len(w) :] = w
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return cls(vocabulary, patterns, sizes, [tuple(sorted(x)) for x in found.values()])


def numbered(texts: list[str | None], vocabulary: dict[bytes, int], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, parted by DOCUMENT, each symbol's document and word place, and each text's word count."""
    get = vocabulary.get
    counts, parts = [], []
    for text in texts:
        w = words(text)
        counts.append(len(w))
        parts.append(np.fromiter((get(x, OTHER) for x in w), np.int64, len(w)))
        parts.append(np.array([DOCUMENT]))
    sizes = np.array(counts, np.int64) + 1
    t = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = t >= FIRST
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    short = (edge[1::2] - edge[::2]) < shortest
    cover = np.zeros(len(t) + 1, np.int64)
    np.add.at(cover, edge[::2][short], 1)
    np.add.at(cover, edge[1::2][short], -1)
    t[np.cumsum(cover[:-1]) > 0] = OTHER
    keep = (t != OTHER) | np.concatenate([[True], t[:-1] != OTHER])
    return t[keep], doc[keep], place[keep], np.array(counts, np.int64)


def search_shard(texts: list[str | None], windows: Windows) -> tuple[list[list[int]], list[list[str]], np.ndarray]:
    """Per text: merged spans of hit words (start, end, start, end...), items with occurring windows; and word counts."""
    shortest = int(windows.sizes.min()) if len(windows.sizes) else WINDOW
    distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # copies are indexed once
    t, doc, place, counts = numbered(list(distinct), windows.vocabulary, shortest)
    spans: list[list[int]] = [[] for _ in distinct]
    items: list[list[str]] = [[] for _ in distinct]
    if len(windows.sizes) and (t >= FIRST).any():
        index = FmIndex(np.append(t, END), len(windows.vocabulary) + FIRST)
        which, low, high = index.search(windows.patterns, windows.sizes)
        size = high - low
        cover, pairs = np.zeros(len(t) + 1, np.int64), []
        for a in _blocks(size, 500_000):
            n = size[a]
            rows = np.repeat(low[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, pattern = index.locate(rows), np.repeat(which[a], n)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.sizes[pattern], -1)
            pairs.append(np.unique(doc[at] * np.int64(len(windows.sizes)) + pattern))
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edge = np.flatnonzero(np.diff(hit.astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            spans[doc[a]] += [int(place[a]), int(place[b - 1]) + 1]
        for d, w in zip(*np.divmod(np.unique(np.concatenate(pairs)), len(windows.sizes)), strict=True) if pairs else ():
            items[d].extend(windows.items[w])
    rows = [distinct[x] for x in texts]
    return [spans[r] for r in rows], [sorted(set(items[r])) for r in rows], counts[rows]


def _blocks(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of about ``limit`` rows each."""
    start, ends = 0, np.cumsum(size)
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield slice(start, stop)
        start = stop


def _merged(a: list[int], b: list[int]) -> list[int]:
    """Two lists of spans as one."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks of about ``block_bytes`` bytes of text, collected one at a time; and whether a block is the last."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = int(-(-total // block_bytes)) or 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n)) == k).collect()], k == n - 1


def find(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = 8_000_000, block_bytes: int = 1_000_000, clean: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_spans (word ranges as start, end, ...) and hit_items (sorted texts).

    With ``clean`` the last pass returns the texts without their spans.
    """
    added = T.StructType.fromDDL("n_words long, hit_spans array<int>, hit_items array<string>")
    found = docs.drop(*added.fieldNames()).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("hit_spans"), F.lit(None).cast("array<string>").alias("hit_items"))
    sc = docs.sparkSession.sparkContext
    for rows, last in benchmark_blocks(benchmark, block_bytes):
        shared = sc.broadcast(Windows.of(rows))  # of block_bytes bytes of text at most, or one item

        def run(frames: Iterator[pa.RecordBatch], shared=shared, cutting=clean and last) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for whole in frames:
                # a shard ends within a batch where the bytes of text say so
                lengths = np.array(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_pylist() or [0])[: whole.num_rows]
                start = 0
                for i, n in enumerate(lengths.tolist()):
                    size += n + 16
                    if size >= shard_bytes:
                        held.append(whole.slice(start, i + 1 - start))
                        yield from _searched(held, shared.value, cutting)
                        held, size, start = [], 0, i + 1
                held.append(whole.slice(start))
            yield from _searched(held, shared.value, cutting)
            release()

        found = found.mapInArrow(run, found.schema)
    return found


def _searched(held: list[pa.RecordBatch], windows: Windows, cutting: bool) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    spans, items, counts = search_shard([t for b in held for t in b.column("text").to_pylist()], windows) if held else ([], [], [])
    at = 0
    for b in held:
        s, i, n = (x[at : at + b.num_rows] for x in (spans, items, counts))
        at += b.num_rows
        s = [_merged(old or [], new) for old, new in zip(b.column("hit_spans").to_pylist(), s, strict=True)]
        i = [sorted({*(old or []), *new}) for old, new in zip(b.column("hit_items").to_pylist(), i, strict=True)]
        own = {"n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(s, pa.list_(pa.int32())), "hit_items": pa.array(i, pa.list_(pa.string()))}
        if cutting:
            own["text"] = pa.array([without_spans(x, y) for x, y in zip(b.column("text").to_pylist(), s, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([own.get(c, b.column(k)) for k, c in enumerate(b.schema.names)], b.schema.names)


def without_spans(text: str | None, spans: list[int] | None) -> str | None:
    """A text without its hit words and what stands between them."""
    if not text or not spans:
        return text
    ends = [m.span() for m in WORD.finditer(text)]  # as many as ``words`` finds, as both cut at the same ASCII characters
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of its text."""
    return find(docs, benchmark, clean=True, **sizes).select(*[c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
    # ends count up and starts count down
    hits = F.expr("aggregate(transform(hit_spans, (x, i) -> CASE WHEN i % 2 = 0 THEN -x ELSE x END), 0L, (s, x) -> s + x)")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )
