"""Operator 13: centroid clustering by Exponion search.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to any other.  After the
centroids have moved, a vector whose bounds still tell them apart isn't looked at again.  For the rest
only centroids inside a ball around the current centroid are tried: all that lie within twice the upper bound plus
the distance from that centroid to its nearest neighbour, cut from a list of centroids sorted by their distance to it.
The radius is inclusive and rounded up, so a centroid that is just as near isn't missed and ties go to the smaller number.

Components are integers, floor(256 * x).  Distances are exact whole numbers: matrix products of doubles where all partial sums stay below 2**53, of
64-bit integers elsewhere; only the bounds are rounded, and always outwards.  The vectors and their bounds are a table in the
shared folder, written anew each round without a shuffle; sums of vectors are partial aggregates by cluster, and k
rows of sums reach the driver.  Distances for a batch are taken by cluster, so no task holds more than a batch.

Defined results: a null vector, one of another length, or with a null or non-finite component is left out; components
beyond +-2**27 count as that, so that squared distances fit in a long; a null vec_id counts as the empty text in the hash; repeated rows
are kept each; equal hashes go by vec_id, then by components; with fewer than k vectors there are as many centroids;
an empty cluster keeps its centroid; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import table, written

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
_MOST = 1 << 27
_OUT = 1 + 1e-9  # bounds are rounded outwards by so much


def whole_vectors(rows: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows with a whole vector, its components as integers."""
    kept = rows.where(F.size(vector) == dimensions).select(F.col(key).alias("id"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            good = np.isfinite(x).all(axis=1)
            v = np.clip(np.floor(x[good] * scale), -_MOST, _MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), _listed(v)], ["id", "v"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, v array<int>")


def _listed(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) + 1
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c.astype(np.int64)):
        d = x.astype(np.int64) - one
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Ball:
    """The centroids, for each one the others by distance, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids
        k = len(centroids)
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, 1) / _OUT  # seen as nearer than they are
        nearest = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.gap = nearest.min(1) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * _OUT
        self.moved = moved
        self.others_moved = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings ``own`` and the bounds up to date, in place; returns how many distances it took."""
        upper += self.moved[own]
        lower -= self.others_moved[own]
        lower /= _OUT
        # whoever stays outside both limits keeps its centroid; equality is looked into
        safe = np.maximum(lower, self.gap[own] / 2 / _OUT)
        at = np.flatnonzero(upper * _OUT >= safe)
        taken = 0
        for j in np.unique(own[at]):
            mine = at[own[at] == j]
            upper[mine] = np.sqrt(squared(x[mine], self.c[j : j + 1])[:, 0].astype(np.float64)) * _OUT
            taken += len(mine)
            mine = mine[upper[mine] >= safe[mine]]
            reach = 2 * upper[mine] + (self.gap[j] if len(self.c) > 1 else 0)
            count = np.searchsorted(self.sorted[j], reach, side="right")  # at least the centroid itself
            ring = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # few classes of nearly equal counts
            for size in np.unique(ring):
                rows = mine[ring == size]
                tried = np.sort(self.order[j][: min(int(size), len(self.c))])
                taken += len(rows) * len(tried)
                d = squared(x[rows], self.c[tried])
                best = np.argmin(d, axis=1)  # the first of equals, which is the smaller number
                two = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64))
                d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
                # beyond the ball all are further away than the reach less the old distance
                rest = np.where(len(tried) < len(self.c), (reach[ring == size] - upper[rows]) / _OUT, np.inf)
                second = np.sqrt(d.min(1).astype(np.float64)) if len(tried) > 1 else np.full(len(rows), np.inf)
                own[rows], upper[rows], lower[rows] = tried[best], two * _OUT, np.minimum(second, rest) / _OUT
        return taken


def _round(rows: DataFrame, ball: Ball, distances: bool) -> DataFrame:
    """``rows`` with cluster and bounds brought up to date; with the exact distance instead of them in the last round."""
    last = "distance long" if distances else "upper double, lower double"
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<int>, cluster int, {last}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, ball.c.shape[1])
            own = b.column(2).to_numpy().astype(np.int64)
            upper, lower = b.column(3).to_numpy().copy(), b.column(4).to_numpy().copy()
            ball.assign(x, own, upper, lower)
            out = [b.column(0), b.column(1), pa.array(own.astype(np.int32))]
            if distances:
                d = np.zeros(len(x), np.int64)
                for j in np.unique(own):
                    d[own == j] = squared(x[own == j], ball.c[j : j + 1])[:, 0]
                out.append(pa.array(d))
            else:
                out += [pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(out, ["id", "v", "cluster", *(["distance"] if distances else ["upper", "lower"])])

    return rows.mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = "2:") -> np.ndarray:
    """The vectors of the smallest hashes, in ascending order of them; k rows reach the driver."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("h"), "id", "v").orderBy("h", "id", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid replaced by the exact floor of its vectors' mean; sums are merged from partial ones."""
    dimensions = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[j].cast("long")).alias(f"s{j}") for j in range(dimensions)])
    out = centroids.copy()
    for r in sums.collect():  # a row a cluster
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dimensions)]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance) of whole vectors, and the final centroids."""
    if not len(centroids):
        return vectors.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    # no bound holds yet: the first round looks from centroid 0
    rows = vectors.select("id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before = None
    for _ in range(rounds):
        rows = written(_round(rows, Ball(centroids, before), False))
        before, centroids = centroids, moved(rows, centroids)
    return written(_round(rows, Ball(centroids, before), True)), centroids


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    rows, centroids = cluster(vectors, first_centroids(vectors))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    whole = sum(r["cluster_inertia"] for r in sums)
    named = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], whole, centroid_digest(centroids[r["cluster"]])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
