import pytest
from pyspark.sql import functions as F

from maskloom import MaskConfig, findings
from maskloom.functions import reuse
from maskloom.operators.masking import masked_line, masked_text
from maskloom.operators.vault import merge_vault, new_tokens, read_vault

CFG = MaskConfig.default("")


def found(spark, lines):
    return findings(spark.createDataFrame([(line,) for line in lines], "text string"), [], "text", CFG)


def rows(spark, path):
    return sorted(tuple(r) for r in read_vault(spark, path).collect())


def test_a_second_run_adds_what_is_new(spark, tmp_path):
    path = str(tmp_path / "it's a vault")
    one = found(spark, ["a@b.de 10.0.0.1", "a@b.de", "c@d.de"] * 20)
    assert merge_vault(one, path, 4) == 3
    before = rows(spark, path)
    assert [r[:2] for r in before] == [("EMAIL", "a@b.de"), ("EMAIL", "c@d.de"), ("IP4", "10.0.0.1")]
    assert merge_vault(one, path, 4) == 0 and rows(spark, path) == before
    assert merge_vault(found(spark, ["e@f.de", "a@b.de"]), path, 4) == 1
    assert merge_vault(found(spark, []), path, 4) == 0
    assert rows(spark, path) == sorted([*before, *(r for r in rows(spark, path) if r[1] == "e@f.de")]) and len(rows(spark, path)) == 4


def test_a_folder_that_spark_takes_for_a_glob(spark, tmp_path):
    with pytest.raises(ValueError, match="glob"):
        merge_vault(found(spark, ["a@b.de"]), str(tmp_path / "v[1]"))


def test_a_vault_outlives_its_session_and_keeps_its_buckets(spark, tmp_path):
    path = str(tmp_path / "vault")
    assert merge_vault(found(spark, ["a@b.de"]), path, 4) == 1
    for table in spark.catalog.listTables():
        if table.name.startswith("maskloom_vault_"):
            spark.sql(f"DROP TABLE {table.name}")  # as in a new session without a catalog of its own
    assert merge_vault(found(spark, ["a@b.de", "c@d.de"]), path, 16) == 1
    assert [r[1] for r in rows(spark, path)] == ["a@b.de", "c@d.de"]


def test_the_old_vault_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "vault")
    merge_vault(found(spark, [f"{i}@b.de" for i in range(200)]), path, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "50"):  # fewer than the buckets, and more
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fresh = new_tokens(found(spark, ["1@b.de", "x@y.de"]), path, 4)
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            # One exchange makes the run's tokens distinct, one deals them to the buckets; none stands above the vault.
            assert plan.count("Exchange ") == 2 and "Bucketed: true" in plan and "SortMergeJoin" in plan, plan
            assert [r["value"] for r in fresh.collect()] == ["x@y.de"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_columns_are_built_once(spark, monkeypatch):
    built = []
    monkeypatch.setattr(reuse, "_BUILT", type(reuse._BUILT)())

    @reuse.built_once
    def build(name, cfg):
        built.append(name)
        return F.upper(name)

    other = MaskConfig.default("pepper")
    for _ in range(3):
        for cfg in (CFG, other):
            df = spark.createDataFrame([("x",)], "a string").select(build("a", cfg))
            assert df.first()[0] == "X"
    assert built == ["a", "a"]
    for i in range(2 * reuse.MOST):
        build(f"c{i}", CFG)
    assert all(len(kept) <= reuse.MOST for kept in reuse._BUILT.values())


@pytest.mark.parametrize("masked", [masked_text, masked_line])
def test_a_column_that_was_built_serves_other_tables(spark, masked):
    for text, n in (("a@b.de", 1), ("c@d.de", 2)):
        df = spark.range(n).select(F.lit(text).alias("t"))
        df = df.select(masked("t", CFG).alias("t"), masked("t", CFG).alias("again"))
        assert all(r["t"] == r["again"] and r["t"].startswith("[EMAIL-") for r in df.collect())
        assert df.join(df.withColumnRenamed("again", "other"), "t").count() == n * n
