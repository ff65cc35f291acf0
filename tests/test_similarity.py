"""The exact self-join by cosine against all pairs."""

import random

import numpy as np
import pytest

from talentlake.operators import similarity


def made(rng, crowd):
    """Directions with near copies around them, exact copies, and vectors of another length."""
    rows = []
    for base in range(12):
        v = np.array([rng.gauss(0, 1) for _ in range(16)])
        for _ in range(crowd if base == 0 else 9):
            rows.append((v * rng.choice([1, 0.5, 30]) + rng.choice([0.02, 0.1, 0.3]) * np.array([rng.gauss(0, 1) for _ in range(16)])).tolist())
    rows += [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)] + [rows[3]] * 20 + [rows[40]] * 2
    rows += [[rng.gauss(0, 1) for _ in range(3)] for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, threshold):
    out = {}
    for i, x in rows:
        for j, y in rows:
            if i < j and len(x) == len(y):
                s = float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
                if s >= threshold:
                    out[i, j] = s
    return out


@pytest.mark.parametrize(("pivots", "block", "threshold"), [(1024, 1000, 0.9), (50, 10, 0.9), (8, 3, 0.97), (30, 5, 0.5), (1, 7, 0.9)])
def test_all_links(spark, pivots, block, threshold):
    rng = random.Random(block)
    rows = made(rng, 70)
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (None, [1.0] * 16)]
    want = brute(rows, threshold)
    frame = spark.createDataFrame(rows + odd, "id long, e array<double>")
    got = {r["id"]: r for r in similarity.cosine_links(frame, "id", "e", threshold, pivots, block).collect()}
    assert set(got) == {i for i, _ in rows}
    cls = {i: min(j for j, y in rows if y == x) for i, x in rows}
    for i, _ in rows:
        beside = {a + b - i: s for (a, b), s in want.items() if i in (a, b)}
        other = sorted((-s, cls[j]) for j, s in beside.items() if cls[j] != cls[i])
        r = got[i]
        assert (r["class"], r["copies"], r["n_links"]) == (cls[i], list(cls.values()).count(cls[i]), len(beside))
        assert (r["best"] is None) == (not other) and (not other or abs(r["best_score"] + other[0][0]) < 1e-8)
    found, _ = similarity.classes(frame, "id", "e")
    pairs = [tuple(r) for r in similarity.cosine_pairs(found, threshold, pivots, block).collect()]
    assert len(pairs) == len({p[:2] for p in pairs}) and {p[:2] for p in pairs} == {(a, b) for a, b in want if cls[a] != cls[b] and cls[a] == a and cls[b] == b}
    assert all(abs(s - want[a, b]) < 1e-9 for a, b, s in pairs)


def test_cells_spare_visits():
    """Vectors in well separated directions visit no other cell."""
    rng = np.random.default_rng(1)
    middles = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    v = np.repeat(middles, 20, axis=0) + 0.02 * rng.normal(size=(640, 32))
    cells = similarity.Cells(middles, 0.9)
    cell = np.argmax(cells.cosines(v), axis=1)
    cells.count({(c, b): 20 for c in range(32) for b in range(3)}, 1000)
    row, _ = cells.visits(v, cell, cells.block_of(cell, np.zeros(640, np.int64), np.zeros(640, np.int64)))
    assert not len(row)


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, e array<float>")
    assert similarity.cosine_links(empty, "id", "e").count() == 0
    one = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [2.0, 4.0])], "id string, e array<float>")
    got = {r["id"]: (r["class"], r["n_links"], r["best"]) for r in similarity.cosine_links(one, "id", "e").collect()}
    assert got == {"x": ("x", 1, "y"), "y": ("y", 1, "x")}


def test_short_floats_keep_what_is_near():
    """The cosines in short floats, by which rows and columns are chosen, err by less than the slack allows, whatever the lengths and sizes."""
    rng = np.random.default_rng(3)
    for width in (1, 8, 64, 3000):
        v = rng.normal(size=(1, width)) + 0.3 * rng.normal(size=(60, width)) * 10.0 ** rng.integers(-5, 6, size=(60, 1))
        v *= 10.0 ** rng.integers(-30, 31, size=(60, 1))
        side = similarity.Side(np.arange(60), np.ones(60, np.int64), v)
        exact = v @ v.T / np.sqrt(side.norm[:, None] * side.norm[None, :])
        assert np.abs(side.unit @ side.unit.T - exact).max() < similarity._SLACK + similarity._ROUGH * width
        some = side.of(np.array([5, 2]))
        assert some.block is side and some.ids.tolist() == [5, 2] and (some.unit == side.unit[[5, 2]]).all()
