"""Exact self-join of vectors by cosine similarity, in cells around pivots.

On unit vectors a cosine of ``t`` or more means a distance of r = sqrt(2 - 2 t) or less.  A bounded number of rows serve as pivots; a vector
lives in the cell of its nearest pivot.  A partner in another cell lies beyond the plane between the two pivots, so a vector visits
only cells whose plane is within r of it.  Cells are divided into rings by the distance to their pivot, and rings of many vectors into
parts; a vector visits the rings that its own distance, r more or less, reaches.  Of two blocks of a cell one visits the other.
Each block then is one matrix: its own vectors are gathered, bounded by ``block``, and the visitors pass by a batch at a time.

Equal vectors are one class before anything is compared, so a vector that a third of all rows hold is compared once.
What grows with the data reaches neither the driver nor one task: pivots, cells and bins are counted by parameters.  Vectors without
any structure lie within r of most planes; such data cost a product of all blocks, as any exact join does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.operators.shared import release, written

#: Distances to a pivot are counted in bins of this width.
BIN = 0.01
_SLACK = 1e-6
#: More than the error of a cosine in short floats is this for each component.
_ROUGH = 2e-7


def classes(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(cid, v, copies) of the distinct vectors, named by their least key, and (key, cid) of all rows that have one.

    Null vectors, empty ones, zero ones and those with a component that is null or not finite have no class.
    """
    x = F.col(vector).cast("array<double>")
    whole = rows.where(F.size(vector) > 0).select(F.col(key).alias("__key"), x.alias("v"))
    whole = whole.where(F.col("__key").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    found = written(whole.groupBy("v").agg(F.min("__key").alias("cid"), F.count("*").alias("copies")))
    return found, whole.join(found.select("v", "cid"), "v").select(F.col("__key").alias(key), "cid")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """The pivots of one length of vector, and the rings of their cells once these are counted."""

    def __init__(self, pivots: np.ndarray, threshold: float):
        self.p = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
        self.r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
        between = np.sqrt(np.maximum(0, 2 - 2 * (self.p @ self.p.T)))
        self.between = np.where(between > 0, between, np.inf)  # of equal pivots the first has all vectors

    def cosines(self, v: np.ndarray) -> np.ndarray:
        return np.clip(v @ self.p.T / np.linalg.norm(v, axis=1, keepdims=True), -1, 1)

    def count(self, counted: dict[tuple[int, int], int], block: int) -> None:
        """Rings out of the vectors in each (cell, bin): runs of bins of ``block`` vectors in all, or one bin in several parts."""
        rings: list[list[int]] = []  # cell, first bin, last bin, parts
        room = 0
        for (cell, b), n in sorted(counted.items()):
            if rings and rings[-1][0] == cell and room + n <= block:
                rings[-1][2], room = b, room + n
            else:
                rings.append([cell, b, b, -(-n // block)])
                room = n
        self.cell, self.low, self.high, self.parts = np.array(rings, np.int64).T
        self.first = np.cumsum(self.parts) - self.parts  # blocks are numbered through all cells

    def block_of(self, cell: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The block in which a vector lives."""
        ring = np.searchsorted(self.cell * 1_000_000 + self.low, cell * 1_000_000 + b, side="right") - 1
        return self.first[ring] + h % self.parts[ring]

    def visits(self, v: np.ndarray, cell: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks that vectors visit: in later cells whose plane is near, and in their own one."""
        cos = self.cosines(v)
        plane = (cos[np.arange(len(v)), cell][:, None] - cos) / self.between[cell]
        later = np.arange(len(self.p))[None, :] >= cell[:, None]
        open_ = (later & (plane <= self.r) | (np.arange(len(self.p))[None, :] == cell[:, None]))[:, self.cell]
        d = np.sqrt(2 - 2 * cos)[:, self.cell]
        row, ring = np.nonzero(open_ & (d + self.r >= self.low * BIN) & (d - self.r <= (self.high + 1) * BIN))
        parts = self.parts[ring]
        row, ring = np.repeat(row, parts), np.repeat(ring, parts)
        to = self.first[ring] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        # within a cell two blocks meet once, in turns, so that none has all the visitors
        mine = own[row]
        meet = (self.cell[ring] != cell[row]) | ((to != mine) & ((mine < to) == ((mine + to) % 2 == 0)))
        return row[meet], to[meet]


def _by_length(b: pa.RecordBatch, at: int = 512) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with vectors of one length; dim is the first column."""
    for k in range(0, b.num_rows, at):
        part = b.slice(k, at)
        dims = part.column(0).to_numpy()
        for n in np.unique(dims):
            yield int(n), part.filter(pa.array(dims == n))


def _dealt(found: DataFrame, threshold: float, pivots: int, block: int) -> DataFrame:
    """(dim, part, visitor, cid, copies, v): every class at home and where it visits."""
    total = found.count()
    block = max(block, total // 10_000)  # so that there are some 10,000 blocks at most
    by: dict[int, list] = {}
    for r in found.select("v").orderBy(F.xxhash64("v"), "v").limit(max(1, min(pivots, total // block))).collect():  # so many rows at most
        by.setdefault(len(r["v"]), []).append(r["v"])
    known = {n: Cells(np.array(p), threshold) for n, p in by.items()}
    cells_of = lambda n: known.get(n) or Cells(np.eye(1, n), threshold)  # noqa: E731  a length without a pivot takes one cell
    kind = found.schema["cid"].dataType.simpleString()
    columns = ["dim", "cell", "bin", "cid", "copies", "h", "v"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n, b in _by_length(whole):
                cos = cells_of(n).cosines(_matrix(b.column(4)))
                cell = np.argmax(cos, axis=1)
                at = (np.sqrt(2 - 2 * cos[np.arange(len(cos)), cell]) / BIN).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(at), *(b.column(k) for k in (1, 2, 3, 4))], columns)

    source = found.select(F.size("v").alias("dim"), "cid", "copies", F.pmod(F.xxhash64("v"), F.lit(1 << 31)).alias("h"), "v")
    # written, as rounding might settle a vector elsewhere when it is computed again in another batch
    settled = written(source.mapInArrow(settle, f"dim int, cell int, bin int, cid {kind}, copies long, h long, v array<double>"))
    counted: dict[int, dict] = {}
    for r in settled.groupBy("dim", "cell", "bin").agg(F.count("*").alias("n")).collect():  # the bins of each pivot
        counted.setdefault(r["dim"], {})[r["cell"], r["bin"]] = r["n"]
    ready = {n: cells_of(n) for n in counted}
    for n, cells in ready.items():
        cells.count(counted[n], block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n, b in _by_length(whole):
                cells, cell = ready[n], b.column(1).to_numpy().astype(np.int64)
                own = cells.block_of(cell, b.column(2).to_numpy(), b.column(5).to_numpy())
                row, to = cells.visits(_matrix(b.column(6)), cell, own)
                for i, block_, visitor in ((np.arange(len(own)), own, False), *((row[k : k + 20_000], to[k : k + 20_000], True) for k in range(0, len(row), 20_000))):
                    at = pa.array(i)
                    made = [pa.array(np.full(len(i), n, np.int32)), pa.array(block_), pa.array(np.full(len(i), visitor)), *(b.column(k).take(at) for k in (3, 4, 6))]
                    yield pa.RecordBatch.from_arrays(made, ["dim", "part", "visitor", "cid", "copies", "v"])

    return settled.mapInArrow(deal, f"dim int, part long, visitor boolean, cid {kind}, copies long, v array<double>")


class Side:
    """Some vectors of a block: ids, copies, components and squared norms."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray):
        self.ids, self.copies, self.v, self.norm = ids, copies, v, np.einsum("ij,ij->i", v, v)
        self.block: Side | None = None  # of which this is a part, at these places
        self.at: np.ndarray | None = None
        self._unit: np.ndarray | None = None

    @property
    def unit(self) -> np.ndarray:
        """The directions in short floats."""
        if self._unit is None:
            self._unit = (self.v / np.sqrt(self.norm)[:, None]).astype(np.float32)
        return self._unit

    def of(self, rows: np.ndarray) -> Side:
        """Some of the vectors, which remember where they stand in the block."""
        some = Side(self.ids[rows], self.copies[rows], self.v[rows])
        some.block, some.at = self, rows
        return some


def _met(dealt: DataFrame, threshold: float, emit, ddl: str, names: list[str]) -> DataFrame:
    """Each block's own vectors against one another and against its visitors, some rows at a time.

    ``emit`` gets two sides, the scores, which of them count, and whether both sides are the block itself, and returns arrays for ``names``.
    """

    def near(x: Side, y: Side, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // max(1, len(y.ids)))
        for k in range(0, len(x.ids), step):
            part = Side(x.ids[k : k + step], x.copies[k : k + step], x.v[k : k + step])
            # a product of short floats, whose error is far below the slack, leaves few rows and columns for the exact one
            close = part.unit @ y.unit.T >= np.float32(threshold - _SLACK - _ROUGH * y.v.shape[1])
            if same:
                close[np.arange(len(part.ids)), np.arange(k, k + len(part.ids))] = False
            i, j = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if not len(i):
                continue
            few, others = part.of(i), y.of(j)
            score = np.round(few.v @ others.v.T / np.sqrt(few.norm[:, None] * others.norm[None, :]), 12)
            good = (score >= threshold) & close[np.ix_(i, j)]
            if good.any():
                for arrays in emit(few, others, score, good, same):
                    yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, own = None, [], None

        def gathered() -> Side:
            return Side(np.concatenate([s.ids for s in parts]), np.concatenate([s.copies for s in parts]), np.concatenate([s.v for s in parts]))

        for b in batches:
            tag = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            ends = np.flatnonzero(np.any(tag[1:] != tag[:-1], axis=1)) + 1
            for s, e in zip([0, *ends], [*ends, len(tag)], strict=True):  # runs of one block and one kind of row
                if s == e:
                    continue
                side = Side(np.array(b.column(3).slice(s, e - s).to_pylist()), b.column(4).slice(s, e - s).to_numpy(), _matrix(b.column(5).slice(s, e - s)))
                if (tag[s, 0], tag[s, 1]) != now:
                    if parts and own is None:
                        yield from near(own := gathered(), own, True)
                    now, parts, own = (tag[s, 0], tag[s, 1]), [], None
                if not tag[s, 2]:
                    parts.append(side)
                elif parts:
                    if own is None:
                        yield from near(own := gathered(), own, True)
                    yield from near(side, own, False)
        if parts and own is None:
            yield from near(own := gathered(), own, True)
        release()

    return dealt.repartition("dim", "part").sortWithinPartitions("dim", "part", "visitor").mapInArrow(run, ddl)


def cosine_pairs(found: DataFrame, threshold: float = 0.9, pivots: int = 1024, block: int = 16_384) -> DataFrame:
    """(a, b, score): all pairs of classes with a cosine of ``threshold`` or more, a < b.  ``threshold`` is above 0."""
    kind = found.schema["cid"].dataType.simpleString()

    def emit(x: Side, y: Side, score: np.ndarray, good: np.ndarray, same: bool) -> Iterator[list]:
        i, j = np.nonzero(good)
        a, b = x.ids[i], y.ids[j]
        first = a < b
        if same:  # each pair stands there twice
            a, b, i, j, first = a[first], b[first], i[first], j[first], first[first]
        yield [pa.array(np.where(first, a, b)), pa.array(np.where(first, b, a)), pa.array(score[i, j])]

    return _met(_dealt(found, threshold, pivots, block), threshold, emit, f"a {kind}, b {kind}, score double", ["a", "b", "score"])


def cosine_cross(found: DataFrame, threshold: float = 0.9, pivots: int = 1024, block: int = 16_384) -> DataFrame:
    """(a, b, score): pairs of classes (cid, v, left, right), a of the left side and b of the right one; a class may be on both."""
    kind = found.schema["cid"].dataType.simpleString()
    sided = found.select("cid", "v", (F.col("left").cast("long") + 2 * F.col("right").cast("long")).alias("copies"))

    def emit(x: Side, y: Side, score: np.ndarray, good: np.ndarray, same: bool) -> Iterator[list]:
        for p, q, s, g in ((x, y, score, good), *([] if same else [(y, x, score.T, good.T)])):
            i, j = np.nonzero(g & ((p.copies & 1) > 0)[:, None] & ((q.copies & 2) > 0)[None, :])
            yield [pa.array(p.ids[i]), pa.array(q.ids[j]), pa.array(s[i, j])]

    return _met(_dealt(sided, threshold, pivots, block), threshold, emit, f"a {kind}, b {kind}, score double", ["a", "b", "score"])


def cosine_forest(found: DataFrame, threshold: float = 0.9, pivots: int = 1024, block: int = 16_384) -> DataFrame:
    """(a, b): links enough to join what pairs at ``threshold`` or more join; a vector sends a link for each group of its neighbours that isn't joined yet."""
    kind = found.schema["cid"].dataType.simpleString()

    def emit(x: Side, y: Side, score: np.ndarray, good: np.ndarray, same: bool) -> Iterator[list]:
        whole = y.block
        if not hasattr(whole, "root"):
            whole.root = np.arange(len(whole.ids))  # of the block's own vectors, for as long as the block lasts
        at = {v: k for k, v in enumerate(whole.ids.tolist())} if same else {}
        a, b = [], []
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            near = np.flatnonzero(good[i])
            roots, first = np.unique(whole.root[y.at[near]], return_index=True)
            if same:
                own = whole.root[at[x.ids[i].item() if hasattr(x.ids[i], "item") else x.ids[i]]]
                others = roots != own
                roots, first = roots[others], first[others]
                keep = own
            else:
                keep = roots[0]
            a += [x.ids[i]] * len(first)
            b += y.ids[near[first]].tolist()
            if len(roots):
                whole.root[np.isin(whole.root, roots)] = keep
        if a:
            yield [pa.array(np.array(a)), pa.array(np.array(b))]

    return _met(_dealt(found, threshold, pivots, block), threshold, emit, f"a {kind}, b {kind}", ["a", "b"])


def cosine_links(rows: DataFrame, key: str, vector: str, threshold: float = 0.9, pivots: int = 1024, block: int = 16_384) -> DataFrame:
    """(key, class, copies, n_links, best, best_score) of every row that has a vector; no pair leaves a task.

    ``class`` is the least key with the same vector and ``copies`` their number, ``n_links`` counts the other rows, copies included, at a cosine
    of ``threshold`` or more, ``best`` is the class with another vector that comes nearest, the least one of ties; null where there is none.
    """
    found, members = classes(rows, key, vector)
    kind = found.schema["cid"].dataType.simpleString()

    def of(x: Side, y: Side, score: np.ndarray, good: np.ndarray) -> list:
        at = np.flatnonzero(good.any(axis=1))
        score, good = np.where(good[at], score[at], -2.0), good[at]
        most = score.max(axis=1)
        ids, rank = np.unique(y.ids, return_inverse=True)
        least = np.where(good & (score == most[:, None]), rank[None, :], len(rank)).min(axis=1)
        return [pa.array(x.ids[at]), pa.array(good @ y.copies), pa.array(most), pa.array(ids[least])]

    def emit(x: Side, y: Side, score: np.ndarray, good: np.ndarray, same: bool) -> Iterator[list]:
        yield of(x, y, score, good)
        if not same:
            yield of(y, x, score.T, good.T)

    met = _met(_dealt(found, threshold, pivots, block), threshold, emit, f"cid {kind}, n long, score double, other {kind}", ["cid", "n", "score", "other"])
    best = F.min(F.struct((-F.col("score")).alias("o"), F.col("other").alias("b")))
    linked = met.groupBy("cid").agg(F.sum("n").alias("n"), best.alias("m"))
    named = written(found.select("cid", "copies").join(linked, "cid", "left"))
    out = members.join(named, "cid")
    return out.select(key, F.col("cid").alias("class"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("m.b").alias("best"), (-F.col("m.o")).alias("best_score"))
