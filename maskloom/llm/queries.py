"""The operators as queries over the whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import (clustering, decontamination, html_wrappers, licenses, merkle, near_duplicates, packing, pii, quality,
                          repeats, secret_scan, topk, vector_duplicates)
from maskloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.report(table(spark, sf_dir, "documents"), size=4)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.passages(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.public_tokenizer())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_top_k": op3_top_k,
    "op4_licenses": op4_licenses,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_repeats": op7_repeats,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_clusters": op12_clusters,
    "op13_vector_duplicates": op13_vector_duplicates,
}

def _round(n: int) -> str:
    """CTEs: the vectors assigned to the centroids c<n>, and the centroids after that."""
    return f"""
        a{n} AS MATERIALIZED (
            SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min([d, k]) AS best
            FROM (SELECT rid, vec_id, q, k, CAST(list_sum(list_transform(list_zip(q, c),
                         lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{n}) GROUP BY rid),
        c{n + 1} AS MATERIALIZED (
            SELECT k, coalesce(m.c, c{n}.c) AS c
            FROM c{n} LEFT JOIN (
                SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY dim) AS c
                FROM (SELECT k, dim, sum(x) AS s, count(*) AS n
                      FROM (SELECT best[2] AS k, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM a{n})
                      GROUP BY k, dim) GROUP BY k) m USING (k))"""


SQL: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_merkle": """
        WITH RECURSIVE steps AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        fields AS (
            SELECT doc_id, source,
                   list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                       lambda v: CASE WHEN v IS NULL THEN '-' ELSE CAST(strlen(v) AS VARCHAR) || ':' || v END),
                       'string_agg', '') AS head,
                   text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
                   coalesce(xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                       lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
                       4294967295) % 5 = 0, false) AS tampered
            FROM documents, steps),
        hashed AS (
            SELECT doc_id, source, tampered,
                   sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(CAST(strlen(lowered) AS VARCHAR) || ':' || lowered, '-')) AS changed
            FROM fields),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   count(*) OVER (PARTITION BY source) AS n
            FROM hashed),
        nodes AS (
            SELECT source, 0 AS lvl, i, n, leaf AS h FROM leaves
            UNION ALL
            SELECT source, lvl + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
            FROM nodes WHERE n > 1 GROUP BY source, lvl, i // 16),
        subroots AS (
            SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
            FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS lvl, i, n, h FROM subroots
            UNION ALL
            SELECT lvl + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
            FROM tops WHERE n > 1 GROUP BY lvl, i // 16),
        runs AS (
            SELECT source, lvl, i // 16 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs
            FROM nodes GROUP BY source, lvl, i // 16),
        top_runs AS (SELECT lvl, i // 16 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs FROM tops GROUP BY lvl, i // 16),
        climbed AS (
            SELECT source, i AS id, 0 AS lvl, i, n, CASE WHEN tampered THEN changed ELSE leaf END AS h, '' AS proof
            FROM leaves
            UNION ALL
            SELECT c.source, c.id, c.lvl + 1, c.i // 16, (c.n + 15) // 16,
                   sha256(array_to_string(hs[:c.i % 16] || [c.h] || hs[c.i % 16 + 2:], '')),
                   c.proof || array_to_string(hs[:c.i % 16] || hs[c.i % 16 + 2:], '')
            FROM climbed c JOIN runs r
              ON c.source IS NOT DISTINCT FROM r.source AND c.lvl = r.lvl AND c.i // 16 = r.r
            WHERE c.n > 1),
        reached AS (
            SELECT c.source, c.id, 0 AS lvl, s.i, s.n, c.h, c.proof
            FROM climbed c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n = 1
            UNION ALL
            SELECT c.source, c.id, c.lvl + 1, c.i // 16, (c.n + 15) // 16,
                   sha256(array_to_string(hs[:c.i % 16] || [c.h] || hs[c.i % 16 + 2:], '')),
                   c.proof || array_to_string(hs[:c.i % 16] || hs[c.i % 16 + 2:], '')
            FROM reached c JOIN top_runs r ON c.lvl = r.lvl AND c.i // 16 = r.r WHERE c.n > 1)
        SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root,
               c.h = t.h AS verified
        FROM leaves l
        JOIN reached c ON l.source IS NOT DISTINCT FROM c.source AND l.i = c.id AND c.n = 1
        JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
        CROSS JOIN (SELECT h FROM tops WHERE n = 1) t""",
    "op12_clusters": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q AS c FROM v QUALIFY k < 16),
        {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)},
        names AS (SELECT k, sha256(array_to_string(c, ',')) AS name FROM c3)
        SELECT vec_id, CAST(best[2] AS INTEGER) AS "cluster", best[1] AS distance,
               CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
               CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
        FROM a3 JOIN names ON names.k = best[2]""",
    "op13_vector_duplicates": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
            FROM embeddings),
        usable AS MATERIALIZED (
            SELECT * FROM v
            WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0),
        pairs AS MATERIALIZED (
            SELECT a.rid, a.vec_id AS a, b.vec_id AS b
            FROM usable a JOIN usable b ON a.rid <> b.rid AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e)
                  / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
        reach AS (
            SELECT vec_id, vec_id AS other FROM usable
            UNION
            SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        degrees AS (SELECT rid, count(*) AS n FROM pairs GROUP BY rid)
        SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
               coalesce(v.vec_id = coalesce(component_id, v.vec_id), false) AS kept
        FROM v LEFT JOIN degrees USING (rid) LEFT JOIN least ON v.vec_id = least.vec_id""",
}
