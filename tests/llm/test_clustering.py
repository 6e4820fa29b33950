import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from maskloom.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int, q int, cluster int, distance long, name string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, "n") for i, v in rows], SCHEMA)


def plain(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 64
            and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:16]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(3):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c
                     for k, c in enumerate(centroids)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in out if c == k) for _, _, k in out}
    name = {k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest() for k in inertia}
    return sorted((i, k, d, inertia[k], sum(inertia.values()), name[k]) for i, d, k in out)


def found(df):
    return sorted(map(tuple, clustering.report(df).collect()))


def test_against_all_distances(spark):
    rng = random.Random(2)
    middle = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in middle[i % 9]]) for i in range(700)]
    rows += [(900 + i, [float(i % 3)] * 64) for i in range(60)]  # ties and copies
    assert found(vectors(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    good = [(i, [i / 7] * 64) for i in range(6)]
    rows = good + [(3, [1.0] * 64), (3, [1.0] * 64), (3, [0.5] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [1.0] * 65),
                   (11, [float("nan")] + [0.0] * 63), (12, [None] + [0.0] * 63), (13, [float("-inf")] + [0.0] * 63), (None, [0.0] * 64)]
    assert found(vectors(spark, rows)) == plain(rows)
    assert found(vectors(spark, [])) == []
    assert found(vectors(spark, rows[-7:])) == []
    assert found(vectors(spark, good[:1])) == plain(good[:1])


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(64)]) for i in range(40)]
    assert found(vectors(spark, rows)) == plain(rows)
    with pytest.raises(PySparkException, match="a component is beyond"):
        found(vectors(spark, [*rows, (99, [3e6] * 64)]))


def test_transform_is_exact():
    rng = np.random.default_rng(4)
    v = rng.integers(-1000, 1000, (50, 64))
    w = clustering.walsh(v)
    assert ((w * w).sum(axis=1) == 64 * (v * v).sum(axis=1)).all()
    assert (w[:, 0] == v.sum(axis=1)).all()
    # Each coefficient is a sum with signs; the signs of coefficient n change n times.
    signs = clustering.walsh(np.eye(64, dtype=np.int64)).T
    assert set(np.unique(signs)) == {-1, 1}
    assert ((signs[:, 1:] != signs[:, :-1]).sum(axis=1) == np.arange(64)).all()


def test_search_drops_only_what_is_worse():
    rng = np.random.default_rng(5)
    v, c = rng.integers(-3, 4, (400, 64)), rng.integers(-3, 4, (16, 64))
    c[9] = c[4]
    v[:16] = c
    number, distance = clustering.nearest(clustering.walsh(v), clustering.walsh(c))
    want = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
