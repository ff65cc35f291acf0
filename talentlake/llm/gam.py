"""Operator 5: quality classifier, a generalised additive model with pairwise interactions.

Cyclic boosting: round by round, feature by feature, a shallow tree on the binned feature
fits the residual, and its leaves are added to that feature's lookup table; then the
strongest pairs of features get two-way tables in the same way.  A score is the sum of
table entries, found for a batch by one gather a table.

The model is fitted on a bounded sample of labelled rows (``sample`` rows, those of the smallest hash of
their id), of which only the features reach the driver; all documents are scored in tasks.

Defined results: null and empty texts have features of zero and are scored like any; labels that
are null don't count, labels of a document that disagree count as their mean; without both classes
among the labels every score is the share of 1 (0.5 without labels); repeated rows each keep
their row; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import add_columns, crc_mod, table
from talentlake.llm.textstats import FEATURES, features


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a shallow tree, grown best split first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, -1, -1)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            G, H, N = g[a:b].cumsum(), h[a:b].cumsum(), n[a:b].cumsum()
            left, right = slice(0, -1), slice(-1, None)
            gain = G[left] ** 2 / (H[left] + ridge) + (G[right] - G[left]) ** 2 / (H[right] - H[left] + ridge) - G[right] ** 2 / (H[right] + ridge)
            gain[(N[left] < least) | (N[right] - N[left] < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], i, a + k + 1)
        if best[1] < 0:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four leaves: its gain and the leaf values."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = G.shape
    a, b = np.ix_(np.arange(rows - 1), np.arange(cols - 1))

    def four(S: np.ndarray) -> list[np.ndarray]:
        q = S[a, b]
        return [q, S[a, cols - 1] - q, S[rows - 1, b] - q, S[-1, -1] - S[a, cols - 1] - S[rows - 1, b] + q]

    gs, hs = four(G), four(H)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gs, hs, strict=True))
    k, m = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [float(x[k, m] / (y[k, m] + ridge)) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: k + 1, : m + 1], out[: k + 1, m + 1 :], out[k + 1 :, : m + 1], out[k + 1 :, m + 1 :] = value
    return float(gain[k, m] - G[-1, -1] ** 2 / (H[-1, -1] + ridge)), out


@dataclass
class Gam:
    """Bin edges, one table a feature and one a chosen pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), _sigmoid(np.array(self.base)))
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i] // 4, b[:, j] // 4]
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.1, leaves: int = 3, least: int = 10, ridge: float = 2.0) -> Gam:
    """Fits the model; the same rows in the same order give the same model."""
    if len(y) == 0:
        return Gam()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    counts = [np.bincount(b[:, j], minlength=s) for j, s in enumerate(sizes)]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            p = _sigmoid(z)
            g, h = np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s)
            step = rate * _leaves(g, h, counts[j], leaves, least, ridge)
            model.tables[j] += step
            z += step[b[:, j]]
    coarse, widths = b // 4, [(s + 3) // 4 for s in sizes]

    def grids(i: int, j: int, p: np.ndarray) -> list[np.ndarray]:
        key, n = coarse[:, i] * widths[j] + coarse[:, j], widths[i] * widths[j]
        return [np.bincount(key, v, n).reshape(widths[i], widths[j]) for v in (y - p, p * (1 - p))]

    p = _sigmoid(z)
    gains = [(_quadrants(*grids(i, j, p), ridge)[0], i, j) for i in range(len(sizes)) for j in range(i) if widths[i] > 1 and widths[j] > 1]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((widths[i], widths[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            step = rate * _quadrants(*grids(i, j, _sigmoid(z)), ridge)[1]
            t += step
            z += step[coarse[:, i], coarse[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Gam:
    """A model of ``labels`` (doc_id, quality), from the features of at most ``sample`` documents."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers: small enough for every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    ddl = ", ".join(f"{f} double" for f in FEATURES)
    rows = add_columns(texts, ["text"], ddl, lambda t: list(features(t).T)).drop("text").dropDuplicates()
    # ids may repeat with many texts: the rows are bounded before they are collected
    rows = rows.orderBy("doc_id", *FEATURES).limit(sample).toPandas().sort_values(["doc_id", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with score and predicted; like-named columns are replaced."""

    def make(texts: list[str | None]) -> list:
        p = model.score(features(texts))
        return [p, (p >= 0.5).astype(np.int32)]

    return add_columns(docs, ["text"], "score double, predicted int", make)


def held_out() -> Column:
    return crc_mod("doc_id", 3) == 1


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
