import random

import pytest

from maskloom.sources import ranges, store


def lines(path, start, end, **how):
    return [line.rstrip(b"\r\n") for _, data in ranges.line_pieces(path, start, end, **how) for line in data.splitlines(True)]


def test_ranges_share_out_all_lines(tmp_path, monkeypatch):
    rng, path = random.Random(1), str(tmp_path / "x.log")
    for _ in range(1500):
        monkeypatch.setattr(ranges, "PIECE", rng.choice([1, 2, 3, 7, 100]))
        data = bytes(rng.choice(b"ab\n\r\n\r") for _ in range(rng.randrange(40)))
        bom = b"\xef\xbb\xbf" * (rng.random() < 0.2)
        with open(path, "wb") as f:
            f.write(bom + data)
        size, step = len(bom + data), rng.choice([1, 2, 3, 5, 8, 50])
        pieces = [p for s in range(0, size, step) for p in ranges.line_pieces(path, s, min(s + step, size))]
        assert b"".join(d for _, d in pieces) == data
        assert [line.rstrip(b"\r\n") for _, d in pieces for line in d.splitlines()] == data.splitlines()
        assert all((bom + data)[at:at + len(d)] == d for at, d in pieces)


def test_a_line_longer_than_many_ranges(tmp_path):
    path = str(tmp_path / "x.log")
    with open(path, "wb") as f:
        f.write(b"a" * 1_000_000 + b"\r\nb\r" + b"c" * 10)
    got = [lines(path, s, s + 1000) for s in range(0, 1_000_014, 1000)]
    assert got[0] == [b"a" * 1_000_000] and got[-1] == [b"b", b"c" * 10] and not any(got[1:-1])


def test_begin_and_limit(tmp_path):
    path = str(tmp_path / "x.log")
    with open(path, "wb") as f:
        f.write(b"one\ntwo three\nfour\n")
    assert lines(path, 7, 19) == [b"four"]
    assert lines(path, 7, 19, begins=True) == [b" three", b"four"]
    assert lines(path, 0, 7, limit=7) == [b"one", b"two"]
    assert lines(path, 0, 7) == [b"one", b"two three"]


def test_urls(tmp_path):
    (tmp_path / "a b%20[1].log").write_text("x")
    url = f"file:{tmp_path}/a b%20[1].log"
    assert store.look(url).kind == "file" and store.look(url).size == 1
    assert [e.url for e in store.children(f"file://{tmp_path}/")] == [f"file://{tmp_path}/a b%20[1].log"]
    assert store.children(str(tmp_path / "none")) == [] and store.look(str(tmp_path / "none")).kind == "none"
    with pytest.raises(OSError, match="can't open nostore://x by pyarrow"):
        store.look("nostore://x/y")


def test_a_store_of_your_own(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "b" / "k").mkdir(parents=True)
    (tmp_path / "b" / "k" / "x.log").write_text("one\ntwo\n")
    monkeypatch.setitem(store.OPENERS, "mine", lambda authority: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), authority))
    assert [e.url for e in store.children("mine://b/k")] == ["mine://b/k/x.log"]
    assert lines("mine://b/k/x.log", 0, 8) == [b"one", b"two"]
