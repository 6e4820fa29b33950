import random
import re

from maskloom.llm import licenses

from cases import ODD, docs

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain(t):
    w = re.findall(WORD, lower(t))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({k for _, k in places})))


def texts():
    rng = random.Random(3)
    parts = ["Under the MIT license", "under the mit", "License", "apache license, version 2", "CC-BY-NC", "cc by", "nc",
             "größe", "0", "😀", "cc by nc by nc", "\n"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)]


def test_base_places_against_plain_reading(spark):
    cases = texts() + ODD
    rows = {r["doc_id"]: r for r in licenses.report(docs(spark, cases)).collect()}
    assert len(rows) == len(cases)
    for i, t in enumerate(cases):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_changed_notices_are_found_along_their_diagonals(spark):
    notice = licenses.TEMPLATES["bsd"].split()
    changed = notice[:8] + ["some", "more"] + notice[8:14] + notice[15:]
    other = " ".join(sorted(notice))
    rows = {r["doc_id"]: r for r in licenses.report(docs(spark, ["a b c " + " ".join(changed), other])).collect()}
    assert rows[0]["labels"] == "bsd" and 0.5 <= rows[0]["score"] < 1
    assert rows[1]["labels"] == "" and rows[1]["score"] == 0


def test_each_notice_alone_gives_its_own_label(spark):
    notices = list(licenses.TEMPLATES.items())
    cases = [f"Copyright by us. {text}. All the rest." for _, text in notices]
    rows = {r["doc_id"]: r for r in licenses.report(docs(spark, cases)).collect()}
    for i, (label, _) in enumerate(notices):
        assert rows[i]["labels"] == label and rows[i]["score"] == 1


def test_notices_side_by_side_and_before_repeated_pieces_keep_their_labels(spark):
    by, sa, mit = (licenses.TEMPLATES[x] for x in ("cc-by", "cc-by-sa", "mit"))
    cases = [by + " commons attribution 4 0" * 20, "commons attribution 4 0 " * 20 + by, f"{by} {sa}", f"{mit} {mit} {by}",
             "commons attribution 4 0 " * 300]
    df = docs(spark, cases)
    rows = {r["doc_id"]: r["labels"] for r in licenses.report(df).collect()}
    assert [rows[i] for i in range(5)] == ["cc-by", "cc-by", "cc-by,cc-by-sa", "cc-by,mit", ""]
    spans = licenses.licence_spans(df).where("doc_id = 3").orderBy("start").collect()
    n = len(re.findall(WORD, lower(mit)))
    assert [(r["label"], r["start"], r["end"]) for r in spans[:2]] == [("mit", 0, n), ("mit", n, 2 * n)] and len(spans) == 3


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = licenses.report(docs(spark, ["cc by nc", "cc by nc", "none", "cc by nc"], [None, None, 5, 5])).collect()
    assert sorted((r["doc_id"] or -1, r["n_base"]) for r in rows) == [(-1, 1), (-1, 1), (5, 0), (5, 1)]
    assert licenses.report(docs(spark, [])).count() == 0
