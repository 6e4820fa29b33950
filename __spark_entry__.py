"""

`queries()` runs every operator over whole tables. `oracle_sql()` computes the
same in DuckDB: for lines built from table columns by putting the tokens in
place directly, with no regular expression; for free text by the same detectors
in another regex engine (`checks/sql_chain.py`).
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import sql_chain as sql
from checks.sql_chain import Chain, Stage, tok
from maskloom import MaskConfig, findings, mask_columns, mask_line, mask_text
from maskloom.functions.tokens import key_token, type_code, typed_token
from maskloom.operators import masking as m
from maskloom.operators import reports
from maskloom.operators.masking import masked_line, masked_text
from maskloom.operators.vault import merge_vault, read_vault
from maskloom.sinks.output_names import plan_output_names
from maskloom.sources.paths import scratch_folder

_HERE = Path(__file__).resolve().parent
LLM_QUERIES, LLM_SQL = {}, {}
# Where the operators for training text are there, an error in them is an error here.
if (_HERE / "maskloom" / "llm" / "queries.py").exists() and (_HERE / "corpus_pipeline.py").exists():
    import corpus_pipeline
    from maskloom.llm.queries import QUERIES, SQL

    LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
    LLM_SQL = {**SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT = MaskConfig.default("")
ALL = MaskConfig.all_types("")
SALTED = MaskConfig.default("pepper")
MIXED = MaskConfig.all_types("", hashing=False, placeholder="$1 <***>")
TERMS = MaskConfig("", scrub_terms=("example", "a.b$c", "éle"))
WORDS = MaskConfig("", site_words=("div", "customer"))


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# --- Lines built from columns ---------------------------------------------------
# name: (masking, table, key, line, expected). Line and expected are SQL that both
# engines read alike; the expected line uses no regular expression.

def _t(code: str, value: str) -> str:
    return tok(f"'{code}'", value)


_C, _S, _O = "CAST(c_custkey AS STRING)", "CAST(s_suppkey AS STRING)", "CAST(o_orderkey AS STRING)"
_HEX = f"right('0000' || {_C}, 4)"
_CODE = f"right('000' || {_S}, 3)"
_TWO = f"right('00' || {_O}, 2)"
_FOUR = f"right('0000' || {_O}, 4)"
_BACK = "chr(92)"
_ACCOUNT = f"'CORP' || {_BACK} || 'user' || {_C}"
_TRUSTED = f"'AUTHORITY' || {_BACK} || 'Network' || {_C}"

_LINES: dict[str, tuple[Callable, str, str, str, str]] = {
    "mask_api_keys": (
        lambda c: m.mask_api_keys(c, DEFAULT), "customer", "c_custkey",
        f"'x-api-key: k' || {_C} || ' then API-KEY =s' || {_C} || ', api-key:'",
        f"'x-api-key: ' || {_t('APIKEY', f"'k' || {_C}")} || ' then API-KEY =' || "
        f"{_t('APIKEY', f"'s' || {_C}")} || ', api-key:'"),
    "mask_bearer": (
        lambda c: m.mask_bearer(c, DEFAULT), "orders", "o_orderkey",
        f"'Authorization: bearer  t' || {_O} || '.x== rest'",
        f"'Authorization: Bearer ' || {_t('TOKEN', f"'bearer  t' || {_O} || '.x=='")} || ' rest'"),
    "mask_ipv6": (
        lambda c: m.mask_ipv6(c, DEFAULT), "customer", "c_custkey",
        f"'at 10:11:12 1:2:3 a:b:c peer fe80::' || {_HEX} || '%3 gw 2001:db8:0:0:0:0:0:' || {_HEX} || '%eth0 up'",
        f"'at 10:11:12 1:2:3 a:b:c peer ' || {_t('IP6', f"'fe80::' || {_HEX} || '%3'")} || ' gw ' || "
        f"{_t('IP6', f"'2001:db8:0:0:0:0:0:' || {_HEX}")} || ' up'"),
    "mask_site_paths": (
        lambda c: m.mask_site_paths(c, DEFAULT), "supplier", "s_suppkey",
        f"'root' || {_BACK} || 'SMS_' || {_CODE} || {_BACK} || 'site_' || {_CODE} || 'x'",
        f"'root' || {_BACK} || 'SMS_' || {_t('SITE', _CODE)} || {_BACK} || 'site_' || "
        f"{_t('SITE', _CODE)} || 'x'"),
    "mask_key_values": (
        lambda c: m.mask_key_values(c, DEFAULT), "supplier", "s_suppkey",
        f"'SQLServerName: DB' || {_S} || ', [SiteCode]=[S' || {_S} || '] catalog = \"d' || {_S} || '\"'",
        f"'SQLServerName: ' || {_t('SRV', f"'DB' || {_S}")} || ', [SiteCode]=[' || "
        f"{tok("'SITE'", f"'S' || {_S}", brackets=False)} || '] catalog = \"' || "
        f"{tok("'DB'", f"'d' || {_S}", brackets=False)} || '\"'"),
    "mask_connection_strings": (
        lambda c: m.mask_connection_strings(c, DEFAULT), "supplier", "s_suppkey",
        f"'Data Source = ' || s_name || '; Initial Catalog=c' || {_S} || '; user id=u' || {_S} || "
        f"'; Password= p ' || {_S} || ';'",
        f"'Data Source=' || {_t('SRV', 's_name')} || '; Initial Catalog=' || {_t('DB', f"'c' || {_S}")} || "
        f"'; user id=' || {_t('SEC', f"'u' || {_S}")} || '; Password=' || "
        f"{_t('SEC', f"'p ' || {_S}")} || ';'"),
    "mask_connection_secrets": (
        lambda c: m.mask_connection_secrets(c, ALL), "supplier", "s_suppkey",
        f"'Pwd=p' || {_S} || ';Uid=u' || {_S} || ';Password=;x'",
        f"'Pwd=' || {_t('SEC', f"'p' || {_S}")} || ';Uid=' || {_t('SEC', f"'u' || {_S}")} || "
        f"';Password=' || {_t('SEC', "''")} || ';x'"),
    "mask_ldap": (
        lambda c: m.mask_ldap(c, DEFAULT), "customer", "c_custkey",
        "'CN=' || c_name || ',OU=' || c_mktsegment || ',DC=corp,DC=local'",
        f"'CN=' || {_t('DN', 'c_name')} || ',OU=' || {_t('DN', 'c_mktsegment')} || ',DC=' || "
        f"{_t('DN', "'[DOMAIN]'")} || ',DC=' || {_t('DN', "'[DOMAIN]'")}"),
    "mask_tr_mobiles": (
        lambda c: m.mask_tr_mobiles(c, DEFAULT), "orders", "o_orderkey",
        f"'GSM +90 532 123 ' || {_TWO} || ' ' || {_TWO} || ' or 0532.123' || {_FOUR} || ' x0532 123 45 67'",
        f"'GSM ' || {_t('PHN', f"'+90 532 123 ' || {_TWO} || ' ' || {_TWO}")} || ' or ' || "
        f"{_t('PHN', f"'0532.123' || {_FOUR}")} || ' x0532 123 45 67'"),
    "mask_ssn": (
        lambda c: m.mask_ssn(c, ALL), "orders", "o_orderkey",
        f"'ssn 123-45-' || {_FOUR} || ' not 0123-45-' || {_FOUR}",
        f"'ssn ' || {_t('SSN', f"'123-45-' || {_FOUR}")} || ' not 0123-45-' || {_FOUR}"),
    "mask_iban": (
        lambda c: m.mask_iban(c, ALL), "orders", "o_orderkey",
        f"'iban TR330006100519786457' || {_FOUR} || ' tr330006100519786457' || {_FOUR}",
        f"'iban ' || {_t('IBAN', f"'TR330006100519786457' || {_FOUR}")} || ' tr330006100519786457' || {_FOUR}"),
    "mask_usernames": (
        lambda c: m.mask_usernames(c, ALL), "customer", "c_custkey",
        f"'by ' || {_ACCOUNT} || ' and (' || {_ACCOUNT} || ') in ' || {_TRUSTED}",
        f"'by ' || {_t('USR', _ACCOUNT)} || ' and (' || {_ACCOUNT} || ') in ' || {_TRUSTED}"),
    "mask_domain_users_allowlist": (
        lambda c: m.mask_domain_users(c, ALL), "customer", "c_custkey",
        f"'login ' || {_ACCOUNT} || ', NT AUTHORITY' || {_BACK} || 'Network Service, Net-Work' || "
        f"{_BACK} || c_mktsegment || {_C}",
        f"'login ' || {_t('USR', _ACCOUNT)} || ', NT AUTHORITY' || {_BACK} || 'Network Service, Net-Work' || "
        f"{_BACK} || c_mktsegment || {_C}"),
    # Off goes only what a switched-off hash replaces: the rest keeps its tokens.
    "mask_placeholder_mixed": (
        lambda c: mask_text(c, MIXED), "customer", "c_custkey",
        f"'u' || {_C} || '@corp.example from 10.0.0.1 on APPSRV' || {_C} || ' Bearer t' || {_C} || "
        f"' api-key=k' || {_C}",
        f"{_t('EMAIL', f"'u' || {_C} || '@corp.example'")} || ' from $1 <***> on $1 <***> $1 <***> api-key=' || "
        f"{_t('APIKEY', f"'k' || {_C}")}"),
    "mask_json_values": (
        lambda c: mask_line(c, DEFAULT), "customer", "c_custkey",
        f"'{{\"user\": {{ \"mail\": \"u' || {_C} || '@corp.example\", \"id\": ' || {_C} || '}}, \"a@b.de\" : "
        f"[\"' || c_name || '\", null, 1.50, \"10.0.0.1\"], \"q\": \"it''s <b> ' || {_BACK} || 'u0041\"}}'",
        f"'{{\"user\":{{\"mail\":\"' || {_t('EMAIL', f"'u' || {_C} || '@corp.example'")} || '\",\"id\":' || {_C} || "
        f"'}},\"a@b.de\":[\"' || c_name || '\",null,1.50,\"' || {_t('IP4', "'10.0.0.1'")} || '\"],\"q\":\"it' || "
        f"{_BACK} || 'u0027s ' || {_BACK} || 'u003Cb' || {_BACK} || 'u003E A\"}}'"),
    "mask_json_nested": (
        lambda c: mask_line(c, DEFAULT), "customer", "c_custkey",
        f"'{{\"orders\": [ {{\"note\": \"first' || {_BACK} || 'nmail u' || {_C} || '@corp.example ' || {_BACK} || "
        f"'\"q' || {_BACK} || '\" 10.0.0.1\", \"tags\": [[], {{}}, \"' || c_mktsegment || '\"]}} ], "
        f"\"k\": {{\"n\": -1.5e3, \"x\": [true, \"10.0.0.2\"]}}}}'",
        f"'{{\"orders\":[{{\"note\":\"first' || {_BACK} || 'nmail ' || "
        f"{_t('EMAIL', f"'u' || {_C} || '@corp.example'")} || ' ' || {_BACK} || 'u0022q' || {_BACK} || 'u0022 ' || "
        f"{_t('IP4', "'10.0.0.1'")} || '\",\"tags\":[[],{{}},\"' || c_mktsegment || '\"]}}],\"k\":{{\"n\":-1.5e3,"
        f"\"x\":[true,\"' || {_t('IP4', "'10.0.0.2'")} || '\"]}}}}'"),
    "mask_salted": (
        lambda c: mask_line(c, SALTED), "customer", "c_custkey",
        f"'mail u' || {_C} || '@corp.example'",
        f"'mail ' || {_t('EMAIL', f"'u' || {_C} || '@corp.example' || 'pepper'")}"),
}


def _line_query(name: str) -> Query:
    masking, table, key, line, _ = _LINES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(key, F.expr(line).alias("line")).select(
            key, "line", masking(F.col("line")).alias("masked"))

    return run


def _line_sql(name: str) -> str:
    _, table, key, line, expected = _LINES[name]
    return f"SELECT {key}, {line} AS line, {expected} AS masked FROM {table}"


# --- Free text, one detector at a time --------------------------------------------
# name: (masking, table, keys, text column, stages)

_TEXTS: dict[str, tuple[Callable, str, tuple[str, ...], str, tuple]] = {
    "mask_emails": (lambda c: m.mask_emails(F.col(c), DEFAULT), "documents", ("doc_id",), "text", (sql.EMAIL,)),
    "mask_phones": (lambda c: m.mask_phones(F.col(c), DEFAULT), "documents", ("doc_id",), "text", (sql.PHONE,)),
    "mask_cards": (lambda c: m.mask_cards(F.col(c), DEFAULT), "documents", ("doc_id",), "text", (sql.CARD,)),
    "mask_ipv4": (lambda c: m.mask_ipv4(F.col(c), ALL), "documents", ("doc_id",), "text", (sql.IPV4,)),
    "mask_thumbprints": (lambda c: m.mask_thumbprints(F.col(c), ALL), "documents", ("doc_id",), "text",
                         (sql.THUMB,)),
    "mask_hostnames": (lambda c: m.mask_hostnames(F.col(c), ALL), "conversations", ("conv_id", "turn"), "text",
                       (sql.HOST,)),
    "mask_fqdns": (lambda c: m.mask_fqdns(F.col(c), ALL), "pages", ("page_id",), "html", (sql.FQDN,)),
    "mask_url_hosts": (lambda c: m.mask_url_hosts(F.col(c), DEFAULT), "pages", ("page_id",), "url", (sql.URL,)),
    "mask_key_values_urls": (lambda c: m.mask_key_values(F.col(c), DEFAULT), "pages", ("page_id",), "url",
                             (sql.KEY_VALUE,)),
    "scrub_terms": (lambda c: m.scrub_terms(F.col(c), TERMS), "documents", ("doc_id",), "text",
                    ((r"(?i)example|a\.b\$c|éle", "[DOMAIN-LC]"),)),
    "scrub_site_words": (lambda c: m.scrub_site_words(F.col(c), WORDS), "pages", ("page_id",), "html",
                         ((r"(?i)\b(?:div|customer)\b", "[SITE-CODE]"),)),
    "mask_documents_default": (lambda c: masked_text(c, DEFAULT), "documents", ("doc_id",), "text",
                               sql.DEFAULT_CHAIN),
    "mask_documents_all": (lambda c: masked_text(c, ALL), "documents", ("doc_id",), "text", sql.FULL_CHAIN),
    "mask_pages_all": (lambda c: masked_text(c, ALL), "pages", ("page_id",), "html", sql.FULL_CHAIN),
}


def _text_query(name: str) -> Query:
    masking, table, keys, column, _ = _TEXTS[name]
    return lambda spark, sf_dir: _table(spark, sf_dir, table, *keys, column).select(
        *keys, masking(column).alias("masked"))


def _text_sql(name: str) -> str:
    _, table, keys, column, stages = _TEXTS[name]
    chain = Chain(f"SELECT {', '.join(keys)}, {column} AS t FROM {table}", keys, stages)
    return f"WITH {', '.join(chain.ctes)} SELECT {', '.join(keys)}, t AS masked FROM {chain.last}"


# --- Tokens and JSON ----------------------------------------------------------------

_TYPES = [*sql.TYPE_CODES, "SomethingElse"]


def _typed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*map(F.lit, _TYPES))
    type_name = F.get(types, (F.col("c_custkey") % len(_TYPES)).cast("int"))
    return _table(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn("type", type_name)


_TYPE_SQL = f"list_value({', '.join(f"'{t}'" for t in _TYPES)})[c_custkey % {len(_TYPES)} + 1]"
_CODE_SQL = ("CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in sql.TYPE_CODES.items())
             + " ELSE 'ID' END")


def token_customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        "c_custkey", key_token("NAME", F.col("c_name"), SALTED).alias("token"))


def token_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_customers(spark, sf_dir).select(
        "c_custkey", "type", typed_token(F.col("type"), F.col("c_name"), DEFAULT).alias("token"))


def type_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_typed_customers(spark, sf_dir).select("type", type_code(F.col("type")).alias("code"))
            .groupBy("type", "code").agg(F.count("*").alias("n")))


def mask_conversations_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations", "conv_id", "turn", F.col("text").alias("masked"))
    return mask_columns(table, ["masked"], DEFAULT)


def mask_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", "event_id", "props").select(
        "event_id", masked_line("props", DEFAULT).alias("masked"))


# --- Reports --------------------------------------------------------------------------

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "source", "text")


def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_documents(spark, sf_dir), ["doc_id"], "text", ALL)


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pii_counts(findings(_documents(spark, sf_dir), ["source"], "text", ALL))


def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pii_totals(findings(_documents(spark, sf_dir), ["source"], "text", ALL))


def token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.token_vault(findings(_documents(spark, sf_dir), [], "text", ALL))


def vault_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault after three runs: over the documents, over the conversations, and over the documents again."""
    path = f"{scratch_folder(spark)}/vault"
    conversations = _table(spark, sf_dir, "conversations", "text")
    for table in (_documents(spark, sf_dir), conversations, _documents(spark, sf_dir)):
        merge_vault(findings(table, [], "text", ALL), path)
    return read_vault(spark, path)


def correlate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.correlate_tokens(findings(_documents(spark, sf_dir), ["source"], "text", ALL))


def token_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders", F.concat(F.lit("order "), F.col("o_orderkey")).alias("value"))
    return reports.token_collisions(
        orders.select(F.lit("KEY").alias("prefix"), "value",
                      key_token("KEY", F.col("value"), DEFAULT).alias("token")))


def residual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit_masking(_documents(spark, sf_dir), "text", DEFAULT, ALL)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(_documents(spark, sf_dir), "source", "text", DEFAULT)


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    names = customers.select(F.expr(_SOURCE_NAME).alias("name"))
    taken = orders.select(F.expr(_TAKEN_NAME).alias("name"))
    return plan_output_names(names, taken)


_SOURCE_NAME = f"'app.' || {_C} || '.log'"
_TAKEN_NAME = ("'app.' || CAST(o_custkey AS STRING) || CASE o_orderstatus WHEN 'F' THEN '' "
               "WHEN 'O' THEN '_sanitized' ELSE '_sanitized_' || CAST(o_orderkey % 3 + 1 AS STRING) END || '.log'")

_DOCS = "SELECT doc_id, source, text AS t FROM documents"
_FULL = Chain(_DOCS, ("doc_id", "source"), sql.FULL_CHAIN)
_FOUND = f"WITH {', '.join(_FULL.ctes)}, found AS ({_FULL.findings()}) "


def _residual_sql() -> str:
    masked = Chain(_DOCS, ("doc_id", "source"), sql.DEFAULT_CHAIN)
    detectors = [s for s in sql.FULL_CHAIN if isinstance(s, Stage)]
    looks = [f"r{n} AS MATERIALIZED (SELECT {s.fenced('t')} AS ps FROM {masked.last})"
             for n, s in enumerate(detectors)]
    left = " UNION ALL ".join(sql.found_by(s, f"r{n}", "") for n, s in enumerate(detectors))
    strip = r"regexp_replace({}, '^\[|\]$', '', 'g')"
    return (f"WITH {', '.join(masked.ctes + looks)}, known AS (SELECT DISTINCT {strip.format('token')} AS k "
            f"FROM ({masked.findings()})), remaining AS ({left}) "
            f"SELECT type, count(*) AS n, count(DISTINCT value) AS n_values FROM remaining "
            f"WHERE {strip.format('value')} NOT IN (SELECT k FROM known) GROUP BY type")


def _vault_merge_sql() -> str:
    talks = Chain("SELECT text AS t FROM conversations", (), sql.FULL_CHAIN, "c")
    found = f"SELECT value, token FROM ({_FULL.findings()}) UNION SELECT value, token FROM ({talks.findings()})"
    return (f"WITH {', '.join(_FULL.ctes + talks.ctes)} "
            f"SELECT split_part(token[2:], '-', 1) AS prefix, value, token FROM ({found})")


def _run_report_sql() -> str:
    chain = Chain("SELECT doc_id, source, text, text AS t FROM documents", ("doc_id", "source", "text"),
                  sql.DEFAULT_CHAIN)
    return (f"WITH {', '.join(chain.ctes)} SELECT source AS source_file, count(*) AS n_lines, "
            f"CAST(count(*) FILTER (WHERE text <> t) AS BIGINT) AS n_changed, "
            f"CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {chain.last} GROUP BY source")


def _output_names_sql() -> str:
    return (f"WITH names AS (SELECT DISTINCT {_SOURCE_NAME} AS name FROM customer), "
            f"existing AS (SELECT DISTINCT {_TAKEN_NAME} AS name FROM orders), "
            "taken AS (SELECT name FROM existing UNION SELECT name FROM names), "
            "tries AS (SELECT n.name, k, replace(n.name, '.log', '_sanitized' || "
            "CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.log') AS candidate "
            "FROM names n, generate_series(0, 4) s(k) WHERE n.name IN (SELECT name FROM existing)), "
            "free AS (SELECT name, arg_min(candidate, k) AS output_name FROM tries "
            "WHERE candidate NOT IN (SELECT name FROM taken) GROUP BY name) "
            "SELECT n.name, coalesce(f.output_name, n.name) AS output_name "
            "FROM names n LEFT JOIN free f ON n.name = f.name")


_TALK = Chain("SELECT conv_id, turn, text AS t FROM conversations", ("conv_id", "turn"), sql.DEFAULT_CHAIN)

_PLAIN: dict[str, tuple[Query, str]] = {
    "mask_conversations_default": (
        mask_conversations_default,
        f"WITH {', '.join(_TALK.ctes)} SELECT conv_id, turn, t AS masked FROM {_TALK.last}"),
    "token_customer_names": (
        token_customer_names,
        f"SELECT c_custkey, {_t('NAME', "c_name || 'pepper'")} AS token FROM customer"),
    "token_typed": (
        token_typed,
        f"SELECT c_custkey, type, {tok(f'({_CODE_SQL})', 'c_name')} AS token "
        f"FROM (SELECT c_custkey, c_name, {_TYPE_SQL} AS type FROM customer)"),
    "type_code_map": (
        type_code_map,
        f"SELECT type, {_CODE_SQL} AS code, count(*) AS n "
        f"FROM (SELECT {_TYPE_SQL} AS type FROM customer) GROUP BY 1, 2"),
    "mask_event_props": (
        mask_event_props, "SELECT event_id, replace(props, ' ', '') AS masked FROM events"),
    "pii_findings": (pii_findings, _FOUND + "SELECT doc_id, type, pos, value, token FROM found"),
    "pii_counts": (pii_counts, _FOUND + "SELECT source, type, count(*) AS n FROM found GROUP BY 1, 2"),
    "pii_totals": (
        pii_totals, _FOUND + "SELECT source, type, count(*) AS n FROM found GROUP BY ROLLUP (source, type)"),
    "token_vault": (
        token_vault,
        _FOUND + "SELECT DISTINCT split_part(token[2:], '-', 1) AS prefix, value, token FROM found"),
    "vault_merge": (vault_merge, _vault_merge_sql()),
    "correlate_tokens": (
        correlate_tokens,
        _FOUND + "SELECT token, count(DISTINCT source) AS n_sources FROM found GROUP BY token "
                 "HAVING count(DISTINCT source) > 1"),
    "token_collisions": (
        token_collisions,
        f"SELECT {_t('KEY', f"'order ' || {_O}")} AS token, count(DISTINCT o_orderkey) AS n_values "
        "FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1"),
    "residual_audit": (residual_audit, _residual_sql()),
    "run_report": (run_report, _run_report_sql()),
    "plan_output_names": (output_names, _output_names_sql()),
}


def entry(spark: SparkSession) -> DataFrame:
    """The documents with the default targets masked."""
    return queries()["mask_documents_default"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every operator as a query: (spark, folder of the tables) -> DataFrame."""
    return {**{name: _line_query(name) for name in _LINES},
            **{name: _text_query(name) for name in _TEXTS},
            **{name: query for name, (query, _) in _PLAIN.items()},
            **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    """The same queries for DuckDB."""
    return {**{name: _line_sql(name) for name in _LINES},
            **{name: _text_sql(name) for name in _TEXTS},
            **{name: statement for name, (_, statement) in _PLAIN.items()},
            **LLM_SQL}
