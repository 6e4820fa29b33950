"""Documents with every odd case, and a corpus of the small tables."""

import random

SCHEMA = ("doc_id long, text string, key long, w string, rep string, count long, spans string, component string, "
          "n_chars long")


def docs(spark, texts, ids=None):
    """Texts as documents with further columns whose names clash with those used inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, 1, "w", "r", 2, "s", "c", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


ODD = [None, "", " \n\t ", "x", "ü 你好 😀", "a" * 50_000, "word " * 20_000, prose(1, 30), prose(1, 30)]
