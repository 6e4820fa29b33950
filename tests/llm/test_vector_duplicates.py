import math
import random

import numpy as np
import pytest

from maskloom.llm import vector_duplicates as vd

SCHEMA = "vec_id long, embedding array<double>, label int, key string, node string, links int, component long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", "n", 1, 2) for i, v in rows], SCHEMA)


def plain(rows):
    def unit(i, v):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(abs(x) for x in v)
        return v / math.sqrt(v @ v)

    units = [unit(*row) for row in rows]
    parent = {i: i for i, _ in rows if i is not None}
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, u in enumerate(units):
        for b in range(a):
            if u is not None and units[b] is not None and len(u) == len(units[b]) and u @ units[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, n, None if i is None else root(i), i is not None and root(i) == i)
                   for (i, _), n in zip(rows, links)), key=str)


def found(df):
    return sorted(map(tuple, vd.report(df).collect()), key=str)


@pytest.mark.parametrize("tile, square", [(8192, 1024), (64, 50)])
def test_against_all_pairs(spark, monkeypatch, tile, square):
    monkeypatch.setattr(vd, "TILE", tile)
    monkeypatch.setattr(vd, "SQUARE", square)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(1000 - k, [x + rng.gauss(0, 0.25) for x in base[k % 20]]) for k in range(400)]
    rows += [(2000 + k, base[0]) for k in range(30)]
    want = plain(rows)
    assert sum(n for _, n, _, _ in want) > 5000
    assert found(vectors(spark, rows)) == want


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 0.5]
    rows = [(1, a), (2, a), (2, a), (3, b), (2, b), (4, None), (5, [0.0] * 3), (6, [float("nan")] * 3), (7, [None] * 3), (8, []),
            (9, [1.0]), (10, [2.0]), (None, a), (11, [1e300] * 3), (12, [3e-300] * 3), (13, [1.0, 2.0, float("inf")]), (14, [-1.0])]
    assert found(vectors(spark, rows)) == plain(rows)
    assert found(vectors(spark, [])) == []
    assert found(vectors(spark, [(5, None), (5, [0.0])])) == [(5, 0, 5, True)] * 2


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 64, 700, 3000):
        v = rng.normal(size=(60, dims)) * rng.uniform(0.01, 100, (60, 1))
        v[::3] *= np.exp(rng.normal(size=(20, dims)))  # few large components: coarse codes
        t = vd.Tile(np.zeros(60), np.arange(60), np.ones(60), v)
        near = (t.codes.astype(np.int64) @ t.codes.T.astype(np.int64)) * t.scale[:, None] * t.scale
        error = t.lost[:, None] + t.lost + t.lost[:, None] * t.lost
        assert (np.abs(near - t.units @ t.units.T) <= error + 1e-12).all()


def test_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=64)
    u /= np.linalg.norm(u)
    rows = []
    for cosine in np.repeat([0.88, 0.899, 0.8999999, 0.9000001, 0.901, 0.92], 40):
        w = rng.normal(size=64)
        w -= (w @ u) * u
        rows.append(cosine * u + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w))
    a = vd.Tile(np.zeros(1), np.zeros(1, int), np.ones(1, int), u[None])
    b = vd.Tile(np.zeros(240), np.arange(240), np.ones(240, int), np.array(rows))
    got = sorted(int(j) for _, js in vd.linked(a, b) for j in js)
    assert got == list(range(120, 240))


def test_forest():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 50
        i, j = rng.integers(0, n, 40), rng.integers(0, n, 40)
        parent = vd.hung(vd.hung(np.arange(n), i[:20], j[:20]), i[20:], j[20:])
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(i, j):
                want[x] = want[y] = min(want[x], want[y])
        assert (parent == want).all()
