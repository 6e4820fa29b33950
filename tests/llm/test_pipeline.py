import corpus_pipeline
from maskloom.llm import decontamination, near_duplicates, pii, quality
from maskloom.llm.common import table

DIR = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = table(spark, DIR, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, table(spark, DIR, "labels")).collect()}
    good = stage["quality"](spark, docs, DIR).cache()
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}
    kept = {r["doc_id"] for r in near_duplicates.report(good, size=5).where("kept").collect()}
    apart = stage["near_duplicates"](spark, good, DIR).cache()
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(kept)
    tests = [r["text"].lower() for r in table(spark, DIR, "benchmark").collect()]
    clean = stage["decontamination"](spark, apart, DIR).cache()
    left = {r["doc_id"]: r for r in clean.collect()}
    leaked = {r["doc_id"] for r in apart.collect() if any(t in r["text"].lower() for t in tests)}
    assert leaked and set(left) == kept - leaked
    masked = stage["pii"](spark, clean, DIR)
    assert masked.columns == clean.columns == docs.columns
    rows = masked.collect()
    assert len(rows) == len(left) and any("[EMAIL]" in r["text"] for r in rows)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and not [c for c in pii.candidates(r["text"]) if c[0] == "email"]
        if "[" not in r["text"]:
            assert r == left[r["doc_id"]]


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert len({r["doc_id"] for r in rows}) > 500
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in s) <= 4096 for s in by_sequence.values())
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table_goes_through_all_stages(spark):
    docs = table(spark, DIR, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_nulls_go_through_all_stages(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0),
                                  (3, "a b@c.example", None, None, 13)], table(spark, DIR, "documents").schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 4, name


def test_decontamination_has_whole_benchmark(spark):
    passes = decontamination.benchmark_passes(table(spark, DIR, "benchmark"))
    assert sum(len(p.items) for p in passes) == table(spark, DIR, "benchmark").count()
