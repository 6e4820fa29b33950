import random
import re
from collections import defaultdict

import numpy as np
import pytest

from maskloom.llm import components as components_module, near_duplicates as nd
from maskloom.llm.common import stored, table
from maskloom.llm.components import components
from maskloom.llm.membership import perhaps_among

from cases import ODD, docs, prose


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset([tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def plain(rows, k):
    """(doc_id, n_shingles, component_id, kept) by comparing all sets that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def family(seed, n, words=60, changes=6):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = prose(rng.random(), 1)
        out.append(" ".join(w))
    return out


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_against_all_pairs(spark):
    texts = [t for s in range(25) for t in family(s, 6)] + family(99, 120, changes=4) + ODD + [prose(s, 40) for s in range(60)]
    rng = random.Random(1)
    ids = rng.sample(range(1000), len(texts))
    assert got(nd.report(docs(spark, texts, ids), size=4)) == plain(list(zip(ids, texts)), 4)


def test_small_corpus_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(nd.report(df, size=4)) == plain(rows, 4)


def test_odd_rows_and_what_stays(spark):
    a, b = prose(5, 50), prose(6, 50)
    table_ = docs(spark, [a, a, a + " x", None, "", a, b, b, "c d e f g h"], [3, 3, 9, 4, 5, None, None, 7, 7])
    rows = nd.report(table_).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 3, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    out = nd.one_of_each(table_)
    assert out.columns == table_.columns
    stay = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
    assert stay == sorted([(-1, a), (-1, b), (3, a), (4, ""), (5, ""), (7, b), (7, "c d e f g h")])
    assert nd.report(docs(spark, [])).count() == 0 and nd.one_of_each(docs(spark, [])).count() == 0


def test_flat_shingles_are_those_of_each_text():
    import pandas as pd
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 9, n) for n in (0, 1, 3, 4, 5, 17, 0, 2)]
    flat, bounds = nd.flat_shingles(pd.Series(texts), 4)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert np.array_equal(flat[a:b], nd.shingle_hashes(t, 4))


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
                                   [(5, 4), (4, 5), (9, 9), (8, 7), (7, 5)]])
def test_components(spark, edges):
    parent = {i: i for e in edges if e[0] != e[1] for i in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in rows) == sorted((i, find(i)) for i in parent)


def test_membership_misses_none(spark):
    ids = spark.range(0, 5000, 3)
    kept = {r["id"] for r in spark.range(0, 9000).where(perhaps_among(ids, "id")).collect()}
    assert set(range(0, 5000, 3)) <= kept and len(kept) < 2500
    assert spark.range(10).where(perhaps_among(ids.where("id < 0"), "id")).count() == 0


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    # With hardly any neighbours met in the orders, what is left must come from the regions themselves.
    monkeypatch.setattr(nd, "NEAR", 2)
    monkeypatch.setattr(nd, "CROWDED", 1)
    monkeypatch.setattr(nd, "BLOCK_BESIDE", 8)
    monkeypatch.setattr(nd, "BLOCK_ALL", 16)
    texts = family(7, 150, words=80, changes=9) + family(8, 40, words=50, changes=5)
    assert got(nd.report(docs(spark, texts), size=4)) == plain(list(enumerate(texts)), 4)


def test_components_that_are_stars_are_told_without_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "stored", lambda df, name: written.append(name) or stored(df, name))
    stars = [(9, 1), (8, 1), (1, 7), (6, 2), (6, 2), (5, 5)]
    found = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (6, 2), (7, 1), (8, 1), (9, 1)]
    assert len(written) == 1


def test_copies_that_share_their_smallest_neighbour_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "stored", lambda df, name: written.append(name) or stored(df, name))
    base = prose("near", 300).split()
    texts = [" ".join(base[:k] + [f"other{k}"] + base[k + 1:]) for k in range(0, 300, 2)]
    rows = nd.report(docs(spark, texts), size=4).collect()
    assert {r["component_id"] for r in rows} == {0}
    # 6 or 7, depending on where the sorted rows are cut; 13 when rounds went on until nothing changed.
    assert len(written) <= 9, len(written)
