import pytest
from helpers import token

from maskloom import MaskConfig, findings, mask_text
from maskloom.functions.tokens import key_token, type_code, typed_token
from maskloom.operators import reports
from pyspark.sql import functions as F

CFG = MaskConfig.all_types("")
TEXTS = [
    (1, "s1", "a@b.de and c@d.de and a@b.de"),
    (2, "s1", "on APPSRV01 a@b.de NT AUTHORITY\\Network"),
    (3, "s2", "Server=db1; ip 10.0.0.1"),
    (4, "s2", "nothing here"),
    (5, "s3", None),
    (6, "s3", '{"k": "APPSRV01", "e": "10.0.0.1"}'),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id bigint, source string, text string")


def test_findings(texts):
    found = findings(texts, ["id"], "text", CFG)
    assert found.columns == ["id", "type", "pos", "value", "token"]
    rows = {tuple(r) for r in found.where("id <= 3").collect()}
    srv = token("SRV", "db1")
    assert rows == {
        (1, "Email", 0, "a@b.de", token("EMAIL", "a@b.de")),
        (1, "Email", 1, "c@d.de", token("EMAIL", "c@d.de")),
        (1, "Email", 2, "a@b.de", token("EMAIL", "a@b.de")),
        (2, "Email", 0, "a@b.de", token("EMAIL", "a@b.de")),
        (2, "Hostname", 0, "APPSRV01", token("HOST", "APPSRV01")),
        (3, "KeyValue", 0, "db1", srv),
        (3, "ConnectionPair", 0, srv, token("SRV", srv)),
        (3, "Hostname", 0, "Server", token("HOST", "Server")),
        (3, "Hostname", 1, token("SRV", srv)[1:-1], token("HOST", token("SRV", srv)[1:-1])),
        (3, "IPv4Address", 0, "10.0.0.1", token("IP4", "10.0.0.1")),
    }


def test_findings_agree_with_masking(texts):
    """Putting each token of a text's findings in place masks it."""
    found = findings(texts.where("id = 1"), ["id"], "text", CFG)
    masked = texts.where("id = 1").select(mask_text(F.col("text"), CFG)).first()[0]
    assert masked.split(" and ") == [r["token"] for r in found.orderBy("pos").collect()]


def test_findings_of_json_lines(texts):
    found = findings(texts.where("id = 6"), ["id"], "text", CFG, as_lines=True)
    assert {r["value"] for r in found.collect()} == {"APPSRV01", "10.0.0.1"}


def test_counts_and_totals(texts):
    found = findings(texts, ["source"], "text", MaskConfig.default(""))
    counts = {(r["source"], r["type"]): r["n"] for r in reports.pii_counts(found).collect()}
    assert counts[("s1", "Email")] == 4
    totals = {(r["source"], r["type"]): r["n"] for r in reports.pii_totals(found).collect()}
    assert totals[(None, None)] == sum(counts.values())
    assert totals[("s1", None)] == 4


def test_vault_and_correlation(texts):
    found = findings(texts, ["source"], "text", CFG).cache()
    vault = reports.token_vault(found)
    rows = vault.collect()
    assert vault.columns == ["prefix", "value", "token"]
    assert len(rows) == len({(r["prefix"], r["value"]) for r in rows})
    assert ("EMAIL", "a@b.de", token("EMAIL", "a@b.de")) in {tuple(r) for r in rows}
    shared = {r["token"]: r["n_sources"] for r in reports.correlate_tokens(found).collect()}
    assert shared == {token("HOST", "APPSRV01"): 2, token("IP4", "10.0.0.1"): 2}


def test_placeholders_are_not_in_the_vault(texts):
    cfg = MaskConfig.default("", hashing=False, placeholder="***")
    vault = reports.token_vault(findings(texts, ["source"], "text", cfg))
    assert vault.where("token = '***'").isEmpty()


def test_collisions(spark):
    # Among this many values of one prefix, clashes of 24-bit tokens are certain.
    values = spark.range(60_000).select(F.lit("X").alias("prefix"),
                                        F.col("id").cast("string").alias("value"))
    vault = values.withColumn("token", key_token("X", F.col("value"), MaskConfig("")))
    found = {r["token"]: r["n_values"] for r in reports.token_collisions(vault).collect()}
    counted = {}
    for i in range(60_000):
        counted[token("X", str(i))] = counted.get(token("X", str(i)), 0) + 1
    assert found == {t: n for t, n in counted.items() if n > 1} and found


def test_residual_audit(texts):
    default = MaskConfig.default("")
    vault = reports.token_vault(findings(texts, ["source"], "text", default))
    masked = texts.select(mask_text(F.col("text"), default).alias("text"))
    assert reports.residual_audit(masked, "text", vault, default).count() == 0
    left = {r["type"]: (r["n"], r["n_values"])
            for r in reports.residual_audit(masked, "text", vault, CFG).collect()}
    assert left == {"Hostname": (3, 2)}
    at_once = reports.audit_masking(texts, "text", default, CFG)
    assert {r["type"]: (r["n"], r["n_values"]) for r in at_once.collect()} == left
    plan = at_once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("Relation") + plan.count("LocalRelation") <= 1
    assert reports.audit_masking(texts, "text", default, default).count() == 0


def test_run_report(texts):
    rows = {r["source_file"]: (r["n_lines"], r["n_changed"], r["n_chars"])
            for r in reports.run_report(texts, "source", "text", MaskConfig.default("")).collect()}
    sizes = {s: sum(len(t or "") for _, x, t in TEXTS if x == s) for s in ("s1", "s2", "s3")}
    assert rows == {"s1": (2, 2, sizes["s1"]), "s2": (2, 1, sizes["s2"]), "s3": (2, 1, sizes["s3"])}


def test_token_functions(spark):
    df = spark.createDataFrame([("Email", "x"), ("Nope", "y"), ("Username", "z")], "t string, v string")
    rows = df.select(type_code(F.col("t")).alias("c"),
                     typed_token(F.col("t"), F.col("v"), MaskConfig("s")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [("EML", token("EML", "x", "s")), ("ID", token("ID", "y", "s")),
                                        ("USR", token("USR", "z", "s"))]


def test_generated_salts_do_not_show_in_plans(spark):
    from maskloom import generate_salt
    from maskloom.plans.jobs import hide_salts

    hide_salts(spark)
    cfg = MaskConfig.default(generate_salt())
    df = spark.range(1).select(mask_text(F.lit("a@b.de"), cfg).alias("t"), mask_text(
        F.col("id").cast("string"), cfg).alias("u"))
    shown = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")
    assert "sha2" in shown and cfg.salt not in shown
