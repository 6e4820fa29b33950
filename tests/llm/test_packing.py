import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from maskloom.llm import packing
from maskloom.llm.common import table

from cases import ODD, docs, prose

PATH = packing.public_tokenizer()


def reference_ids(texts):
    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids_of):
    """Every id in exactly one piece, checksums right, sequences gapless and short enough."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            piece = np.array(ids[at:at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids)
    used = padded = 0
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.WINDOW
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else packing.WINDOW)
    return 1 - used / padded


def test_round_trip_and_padding(spark):
    df = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 2500")
    source = df.collect()
    ids = dict(zip((r["doc_id"] for r in source), reference_ids([r["text"] for r in source])))
    assert check(packing.pack(df, PATH).collect(), ids) < 0.01


def test_odd_rows(spark):
    texts = ODD + [prose(i, 3000) for i in range(4)]
    assert check(packing.pack(docs(spark, texts), PATH).collect(), dict(enumerate(reference_ids(texts)))) < 0.5
    rows = packing.pack(docs(spark, ["a", "a", None], [None, None, 3]), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows) == [(-1, 2), (-1, 2), (3, 1)]
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_ids_are_those_of_the_vocabularys_own_library():
    rng = random.Random(1)
    letters = "aaabceeehistlnorthe'’''012 .,-_%\n\t\x1c\xa0éÉèßÆøÿµªº²½<|>endoftextΣσſK你好😀éİ\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "a" * 5000, " don't they'LL %'s I'VE", "Straße ÀÖØöøÿ ×÷"]
    for got, want in zip(packing.WordIds(PATH).encode(texts), reference_ids(texts)):
        assert got == np.array(want, "<u4").tobytes()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 10)
    texts = [prose(i, 30) for i in range(20)]
    encoder = packing.WordIds(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == reference_ids(texts)
    assert len(encoder.known) < 60


def test_lengths_of_every_kind_pack():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 4097, 3000), np.full(50, 4096), np.full(50, 2049), np.array([1]), np.full(1000, 1),
                    rng.integers(1, 60, 500), rng.integers(4000, 4097, 100)):
        sequences = packing.pack_lengths(lengths)
        assert sorted(i for s in sequences for i in s) == list(range(len(lengths)))
        assert all(lengths[s].sum() <= packing.WINDOW for s in sequences)
        assert len(sequences) <= 1.1 * np.ceil(lengths.sum() / 4096) + (lengths > 2048).sum()


def test_least_squares_is_non_negative_and_close():
    rng = np.random.default_rng(1)
    a = rng.random((20, 8))
    x = np.array([0, 3, 0, 1, 2, 0, 0, 5.0])
    found = packing.non_negative_least_squares(a, a @ x, steps=20_000)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-2
