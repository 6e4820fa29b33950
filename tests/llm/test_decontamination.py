import random

import numpy as np

from maskloom.llm import decontamination as dc
from maskloom.llm.common import table

from cases import ODD, docs, prose


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_passages_at_every_place_are_found_and_others_left_alone(spark):
    lengths = [1, 3, 5, 8, 11, 12, 15, 19, 23, 38, 59, 150, 400]
    tests = [prose(f"item{n}", n) for n in lengths]
    rng = random.Random(2)
    texts, want = [], set()
    for i in range(90):
        n = i % len(tests)
        before = rng.randrange(40)
        texts.append(f"{prose(i, before)} {tests[n].upper().replace(' ', ', ')} {prose(i + 500, rng.randrange(40))}")
        want.add((i, n))
    texts += [prose(1000 + i, 200) for i in range(30)] + [tests[10][:len(tests[10]) // 2]] + ODD[:5]
    rows = dc.leaks(docs(spark, texts), items(spark, tests)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    short = {n for n, k in enumerate(lengths) if k < 5}  # a short item may stand elsewhere too
    assert want <= found and {p for p in found - want if p[1] not in short} == set()
    assert all(r["similarity"] == 1.0 for r in rows if (r["doc_id"], r["item_id"]) in want)
    for r in rows:
        if (r["doc_id"], r["item_id"]) in want and lengths[r["item_id"]] > 11:
            assert abs(r["end_word"] - r["first_word"] - lengths[r["item_id"]]) <= 3


def test_light_changes_are_found(spark):
    words = prose("long item", 60).split()
    words[30] = "other"
    rows = dc.leaks(docs(spark, [prose(1, 50) + " " + " ".join(words)]), items(spark, [prose("long item", 60)])).collect()
    assert len(rows) == 1 and 0.8 <= rows[0]["similarity"] < 1


def test_block_index_guarantees_the_radius():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2 ** 62, 40)
    benchmark = dc.Benchmark([(7, w)])
    (marks, _, tables), = benchmark.classes.values()
    for _ in range(300):
        mark = int(marks[rng.integers(len(marks))])
        for bit in rng.choice(64, dc.RADIUS, replace=False):
            mark ^= 1 << int(bit)
        assert any(t[(mark >> 16 * b & 0xFFFF) + 1] > t[mark >> 16 * b & 0xFFFF] for b, (t, _) in enumerate(tables))


def test_fingerprints_are_majorities_of_each_window():
    rng = np.random.default_rng(5)
    w = rng.integers(-2 ** 63, 2 ** 63, 70)
    bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1)
    for size, stride in ((12, 4), (7, 1), (28, 4)):
        marks = dc.fingerprints(w, size, stride)
        assert len(marks) == (70 - size) // stride + 1
        for n, mark in enumerate(marks):
            want = np.packbits(bits[n * stride:n * stride + size].sum(axis=0) > size // 2).view(np.uint64)[0]
            assert mark == want


def test_odd_rows_and_filter(spark):
    item = prose("i", 30)
    df = docs(spark, [item, item, None, "", item, "clean"], [1, 1, 2, 3, None, 4])
    odd = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "..")], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in dc.leaks(df, odd).collect()) == [(-1, 1), (1, 1), (1, 1)]
    kept = dc.clean_documents(df, odd)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert dc.clean_documents(df, odd.where("item_id > 9")).count() == 6
    assert dc.leaks(df, odd.where("item_id > 9")).count() == 0 and dc.leaks(docs(spark, []), odd).count() == 0


def test_passes_over_many_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_PER_PASS", 3)
    tests = [prose(f"t{i}", 20) for i in range(10)]
    df = docs(spark, [f"{prose(i, 9)} {t}" for i, t in enumerate(tests)] + ["clean"])
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.leaks(df, items(spark, tests)).collect()) == [(i, i) for i in range(10)]
    assert [r["doc_id"] for r in dc.clean_documents(df, items(spark, tests)).collect()] == [10]


def test_small_tables(spark):
    d, b = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in dc.leaks(d, b).collect()}
    tests = [(r["item_id"], r["text"].lower()) for r in b.collect()]
    want = {(r["doc_id"], i) for r in d.collect() for i, t in tests if t in r["text"].lower()}
    assert want and want <= found


def test_edits_that_similarity_allows_for_are_never_missed():
    rng = np.random.default_rng(8)
    item = lambda n: rng.integers(-2 ** 63, 2 ** 63 - 1, n)
    missed = 0
    for n, edits in ((9, 0), (11, 0), (12, 0), (30, 1), (40, 1), (60, 2), (100, 3), (200, 7)):
        for _ in range(40):
            w = item(n)
            changed = w.copy()
            changed[rng.choice(np.arange(1, n - 1), edits, replace=False)] = item(edits)
            changed[0] = item(1)[0] if not edits else changed[0]  # short items: their first word
            text = np.concatenate([item(int(rng.integers(30))), changed, item(int(rng.integers(30)))])
            share = np.isin(dc.shingles(w), dc.shingles(changed)).mean()
            if share >= dc.SIMILARITY:
                missed += not dc.Benchmark([(1, w)]).find(text, np.array([len(text)]))
    assert missed == 0


def test_items_with_words_put_in_or_left_out_are_found():
    rng = np.random.default_rng(9)
    item = lambda n: rng.integers(-2 ** 63, 2 ** 63 - 1, n)
    for n, put_in, left_out in ((30, 30, 0), (100, 30, 0), (100, 40, 0), (100, 60, 0), (100, 200, 0), (60, 256, 0), (100, 0, 10), (200, 0, 20)):
        for _ in range(20):
            w = item(n)
            at = int(rng.integers(14, n - 14 - left_out))
            changed = np.concatenate([w[:at], item(put_in), w[at + left_out:]])
            text = np.concatenate([item(40), changed, item(50)])
            (row, which, first, end, share), = dc.Benchmark([(1, w)]).find(text, np.array([len(text)]))
            assert share >= dc.SIMILARITY and -n // 3 <= first - 40 and first < end and end - 40 - len(changed) <= n // 3
    w = item(100)
    apart = np.concatenate([w[:50], item(400), w[50:]])  # two halves far from each other are no passage
    assert not dc.Benchmark([(1, w)]).find(apart, np.array([len(apart)]))


def test_the_earliest_of_equal_places_wins():
    w = np.arange(40) * 0x9E3779B97F4A7C1
    text = np.concatenate([np.arange(7) + 10 ** 9, w, np.arange(90) + 10 ** 10, w])
    (_, _, first, end, share), = dc.Benchmark([(1, w)]).find(text, np.array([len(text)]))
    assert share == 1.0 and first <= 7 and end - first == 40


def test_spread_counts_the_items_of_all_passes(spark, monkeypatch):
    common = prose("common", 12)
    tests = items(spark, [f"{common} {prose(f'own {i}', 12)}" for i in range(6)])
    whole, = dc.benchmark_passes(tests)
    assert len(whole.items) == 6
    monkeypatch.setattr(dc, "ITEMS_PER_PASS", 2)
    totals = sorted(t for b in dc.benchmark_passes(tests) for t in b.totals)
    assert np.allclose(totals, sorted(whole.totals))
