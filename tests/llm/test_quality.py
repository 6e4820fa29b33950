import zlib

import numpy as np
import pytest

from maskloom.llm import quality
from maskloom.llm.common import table

from cases import ODD, docs


@pytest.fixture(scope="module")
def scored(spark):
    d, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = quality.score_documents(d, labels).join(labels, "doc_id", "left").collect()
    return rows, d.count()


def test_held_out_accuracy(scored):
    rows, n = scored
    assert len(rows) == n
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    d, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    other = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_documents(d, x).collect()} for x in (labels, other))
    assert a == b


def plain_risk(model, weights, bias, positive, unlabelled, prior):
    """The non-negative risk, row by row."""
    def mean(rows, y):
        total = 0.0
        for bins in model.bins(rows):
            total += (1 - y * (sum(weights[b] for b in bins) + bias)) ** 2 / 4
        return total / len(rows)

    return prior * mean(positive, 1) + max(0.0, mean(unlabelled, -1) - prior * mean(positive, -1))


def drawn(rng, good=1800, bad=1200):
    positive = rng.normal(2, 1, (2000, 2))
    unlabelled = np.concatenate([rng.normal(2, 1, (good, 2)), rng.normal(-2, 1, (bad, 2))])
    cuts = np.quantile(unlabelled, np.linspace(0, 1, 13)[1:-1], axis=0).T
    blank = quality.QualityModel(cuts, np.zeros(24))
    return positive, unlabelled, cuts, *(quality.moments(blank.bins(x), 24) for x in (positive, unlabelled))


def test_non_negative_risk_separates_and_estimates_the_prior():
    positive, unlabelled, cuts, ours, others = drawn(np.random.default_rng(0))
    first = quality.fit_risk(cuts, ours, others, 0.5)
    limits = np.quantile(first.margin(positive), quality.TAILS)
    # The plain prior: for each limit, count rows one by one.
    above = np.array([sum(z >= c for z in first.margin(unlabelled)) for c in limits])
    prior = quality.estimate_prior(first.margin(positive), limits, above, len(unlabelled))
    assert 0.5 < prior < 0.75
    z = quality.fit_risk(cuts, ours, others, prior).margin(unlabelled)
    assert np.mean((z > 0) == (np.arange(3000) < 1800)) > 0.95


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_no_weights_near_by_have_a_lesser_risk(prior):
    rng = np.random.default_rng(1)
    positive, unlabelled, cuts, ours, others = drawn(rng, 180, 120)
    model = quality.fit_risk(cuts, ours, others, prior, decay=1e-9)
    least = plain_risk(model, model.weights, model.bias, positive, unlabelled, prior)
    for scale in (1e-3, 1e-2, 0.1, 1):
        for _ in range(5):
            step = rng.normal(0, scale, 25)
            assert plain_risk(model, model.weights + step[:-1], model.bias + step[-1], positive, unlabelled, prior) > least - 1e-6


def test_all_unlabelled_rows_count(spark):
    df = docs(spark, [f"{'word ' * (n % 40)}{n} END." for n in range(500)])
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(0, 500, 7)], "doc_id long, quality int")
    table = quality.marked(df, labels)
    rows = table.where(quality.F.col("quality").isNull())
    x = np.array([r["x"] for r in rows.collect()], np.float32)
    cuts = quality.quantiles(rows.repartition(3))
    for i, limits in enumerate(cuts):
        grid = np.sort((x[:, i].view(np.uint32) if x[:, i].flags.c_contiguous else x[:, i].copy().view(np.uint32)) >> 16)
        want = (grid[[min(len(grid) - 1, k * len(grid) // quality.BINS) for k in range(1, quality.BINS)]] << 16).astype(np.uint32)
        assert np.array_equal(limits.astype(np.float32), want.view(np.float32))
    blank = quality.QualityModel(cuts, np.zeros(quality.BINS * len(quality.FEATURES)))
    pairs = quality._all_moments(rows.repartition(3), blank)
    assert pairs[-1, -1] == len(x) and np.array_equal(pairs, quality.moments(blank.bins(x), len(blank.weights)))


def test_odd_rows(spark):
    df = docs(spark, ODD + ["a b c"], [*range(len(ODD)), None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_documents(df, none).collect()
    assert len(rows) == len(ODD) + 1 and {r["score"] for r in rows} == {0.5}
    odd = spark.createDataFrame([(3, 1, 2), (3, 1, 2), (4, 0, 2), (5, None, 1), (None, 1, 1), (6, 7, 1)],
                                "doc_id long, quality int, score int")
    rows = quality.score_documents(df, odd).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(docs(spark, []), odd).count() == 0
    kept = quality.good_documents(df, none)
    assert kept.columns == df.columns and kept.count() == df.count()
