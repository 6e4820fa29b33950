import math
import random

import numpy as np

from maskloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block long, slot int, dims int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def plain(rows, every=100, k=10):
    usable = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
              if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, v in usable:
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(v) == len(w)]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df, **how):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **how).collect())


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(700)]
    rows += [(i, rows[i % 7][1]) for i in range(700, 760)]  # ties
    rows += [(800, [3e3] * 16), (801, [-3e3] * 16), (802, [0.0] * 16)]
    assert found(vectors(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (5, [1.0]), (100, [-1.0, 0.5]), (100, [-1.0, 0.5]), (6, []), (200, []), (-100, [2.0, 2.0])]
    got = found(vectors(spark, rows))
    assert sorted(set(got)) == sorted(set(plain(rows)))
    assert found(vectors(spark, [])) == []
    assert found(vectors(spark, [(0, [1.0])])) == []


def test_many_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-900, 900) for _ in range(5)]) for i in range(500)]
    assert found(vectors(spark, rows), every=50, k=3) == plain(rows, 50, 3)


def test_sums_of_slices():
    rng = np.random.default_rng(1)
    attrs = rng.integers(-50, 60, (130, 4))
    index = topk.BitSlices(attrs)
    queries = rng.integers(-9, 9, (3, 4))
    slices = index.sums(np.abs(queries), queries < 0)
    coarse = (attrs - attrs.min(axis=0)) >> index.shift
    for q, query in enumerate(queries):
        want = sum(abs(w) * (coarse[:, d] if w >= 0 else index.top - coarse[:, d]) for d, w in enumerate(query))
        bits = [np.unpackbits(s[q].view(np.uint8), bitorder="little")[:130].astype(int) << b for b, s in enumerate(slices)]
        assert (sum(bits) == want).all()
        every = topk._bitmaps(np.ones((130, 1)))[0]
        own = [s[q] for s in slices]
        assert topk.kth_sum(own, every, 7) == np.sort(want)[-7]
        near = np.flatnonzero(np.unpackbits(topk.at_least(own, every, int(np.sort(want)[-7])).view(np.uint8), bitorder="little"))
        assert set(near) == set(np.flatnonzero(want >= np.sort(want)[-7]))
