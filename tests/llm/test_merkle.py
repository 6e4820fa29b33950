import hashlib
import zlib

import pytest

from maskloom.llm import merkle

SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, tree string, key long, rank long, item string, "
          "part long, at long")


def docs(spark, rows):
    return spark.createDataFrame([(*row, "t", 1, 2, "i", 3, 4) for row in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(row):
    text = row[4] if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
    return (*row[:4], text)


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i:i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def path(tree, i):
    for nodes in tree[:-1]:
        first = i - i % 16
        yield nodes[first:i], nodes[i + 1:first + 16]
        i //= 16


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))])
             for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = [*path(trees[s], i), *path(top, k)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = leaf(lowered(row) if tampered else row)
            for left, right in steps:
                value = h(*left, value, *right)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), value,
                        value == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, merkle.report(df).collect()), key=str)


def test_against_plain_trees(spark):
    rows = [(i * 7 % 1000, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text {i} ÄÖ") for i in range(1000)]
    assert found(docs(spark, rows)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 272, 513])
def test_every_shape_of_a_source(spark, n):
    rows = [(i, "a", None, None, "X") for i in range(n)] + [(n, "b", None, None, None)]
    assert found(docs(spark, rows)) == plain(rows)


def test_many_sources_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    rows = [(i, f"s{i % 300}" if i % 2 else "hot", "de", 1, "A" * (i % 9)) for i in range(1500)]
    assert found(docs(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "", None, None, "Ü😀 ABC"), (1, "", None, None, "Ü😀 ABC"),
            (1, "", None, None, "other"), (5, "-", "-", -1, "A" * 200_000), (-3, "é", "x", 2, "\n"), (2 ** 62, None, "x", 2, "B")]
    assert found(docs(spark, rows)) == plain(rows)
    assert found(docs(spark, [])) == []
    assert found(docs(spark, rows[:1])) == plain(rows[:1])


@pytest.mark.parametrize("levels_", [1, 2, 3, 4, 5])
def test_layout_is_van_emde_boas(levels_):
    places = [(depth, i, merkle.address(levels_, depth, i)) for depth in range(levels_) for i in range(16 ** depth)] \
        if levels_ < 5 else [(d, i, merkle.address(5, d, i)) for d in range(5) for i in range(0, 16 ** d, max(1, 16 ** d // 999))]
    if levels_ < 5:
        assert sorted(a for _, _, a in places) == list(range(merkle.size(levels_)))
    upper = levels_ // 2
    for depth, i, a in places:
        if levels_ > 1 and depth < upper:  # the upper half comes first, laid out the same way
            assert a == merkle.address(upper, depth, i)
        elif levels_ > 1:  # then every lower subtree in one piece
            subtree, inside = divmod(i, 16 ** (depth - upper))
            start = merkle.size(upper) + subtree * merkle.size(levels_ - upper)
            assert a == start + merkle.address(levels_ - upper, depth - upper, inside)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 300, 4096])
def test_siblings_in_a_block_of_three_levels(n, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 3)
    monkeypatch.setattr(merkle, "SPAN", 4096)
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    up = merkle.lifts(n)
    block = merkle.Block(merkle.laid_out([bytes.fromhex(x) for x in leaves], up), n, up)
    assert block.node(0, 0) == tree[-1][0]
    for i in range(0, n, 7):
        assert list(block.siblings(i)) == [("".join(a), "".join(b)) for a, b in path(tree, i)]


def test_changed_rows_change_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "a") for i in range(40)]
    one = merkle.manifest(docs(spark, rows)).root
    assert one == merkle.manifest(docs(spark, rows[::-1])).root
    assert one != merkle.manifest(docs(spark, [*rows[:-1], (39, "s0", "en", 1, "b")])).root
    assert merkle.manifest(docs(spark, [])).root is None
