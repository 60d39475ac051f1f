"""Shared pieces of the DuckDB oracle SQL (independent formulation of the
domain views and of redaction, for the correctness gate)."""

from __future__ import annotations

from ..functions.patterns import DETECTORS, Detector, re2_pattern


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


PROMPTS_CTE = """prompts AS (
  SELECT 'req_' || substr(sha256('order:' || o.o_orderkey::VARCHAR), 1, 16) AS request_id,
         o.o_orderkey AS o_orderkey,
         't' || (o.o_custkey % 4)::VARCHAR AS tenant,
         c.c_name AS user_name,
         CASE WHEN o.o_orderkey % 20 = 0 THEN 'sealed' WHEN o.o_orderkey % 97 = 0 THEN 'gold' END AS explicit_tier,
         CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE 'model-' || lower(o.o_orderstatus) END AS model,
         CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE ((o.o_orderkey % 4 + 1) * 256)::INTEGER END AS max_tokens,
         (CASE WHEN o.o_orderkey % 4 <> 3 THEN 'Invoice from Vendor' || o.o_custkey::VARCHAR || ' AG' ELSE 'Invoice' END)
         || (CASE WHEN o.o_orderkey % 2 = 0 THEN ' for CHF ' || floor(o.o_totalprice)::BIGINT::VARCHAR ELSE ' for a small amount' END)
         || (CASE WHEN o.o_orderkey % 7 = 0 THEN ', account ' || lpad((o.o_custkey % 100)::VARCHAR, 2, '0') || '.'
                  || lpad((o.o_orderkey % 1000)::VARCHAR, 3, '0') || '.' || lpad((o.o_custkey % 1000)::VARCHAR, 3, '0')
                  || '.' || lpad(((o.o_orderkey * 7) % 1000)::VARCHAR, 3, '0') || '.' || (o.o_orderkey % 10)::VARCHAR
             ELSE '' END)
         || (CASE WHEN o.o_orderkey % 11 = 0 THEN ', ref zv' || strftime(o.o_orderdate, '%Y%m%d') || '/'
                  || lpad((o.o_orderkey % 1000000)::VARCHAR, 6, '0') || '/' || (o.o_custkey % 9 + 1)::VARCHAR
             ELSE '' END)
         || (CASE WHEN o.o_orderkey % 5 = 0 THEN ', IBAN CH' || lpad(c.c_nationkey::VARCHAR, 2, '0') || ' '
                  || lpad((o.o_custkey % 10000)::VARCHAR, 4, '0') || ' ' || lpad((o.o_orderkey % 10000)::VARCHAR, 4, '0')
                  || ' ' || lpad(((o.o_orderkey * 13) % 10000)::VARCHAR, 4, '0') || ' ' || (o.o_orderkey % 10)::VARCHAR
             ELSE '' END)
         || (CASE WHEN o.o_orderkey % 13 = 0 THEN ', card 4' || lpad((o.o_orderkey % 1000)::VARCHAR, 3, '0') || ' '
                  || lpad((o.o_custkey % 10000)::VARCHAR, 4, '0') || ' 1111 ' || lpad((o.o_orderkey % 10000)::VARCHAR, 4, '0')
             ELSE '' END)
         || (CASE WHEN o.o_orderkey % 3 = 0 THEN '. Contact ap' || o.o_custkey::VARCHAR || '@vendor'
                  || (o.o_custkey % 50)::VARCHAR || '.example.com' ELSE '' END)
         || (CASE WHEN o.o_orderkey % 6 = 0 THEN '. Again Vendor' || o.o_custkey::VARCHAR || ' AG.' ELSE '.' END) AS text
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
)"""

CORPUS_CTE = PROMPTS_CTE + """,
corpus AS (
  SELECT 'prompt' AS kind, o_orderkey AS id, text FROM prompts
  UNION ALL SELECT 'doc' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page' AS kind, page_id AS id, html AS text FROM pages
)"""

TOKEN_LIST_TYPE = "STRUCT(token VARCHAR, value VARCHAR, entity VARCHAR)[]"


def redaction_ctes(src: str, text_expr: str, prefix: str = "rd",
                   detectors: tuple[Detector, ...] = DETECTORS) -> tuple[str, str]:
    """CTEs that redact ``text_expr`` of relation ``src``.

    Returns (sql_fragment, final_cte_name).  The final relation has the source
    columns plus t (redacted text), toks (token list) and n_<type> counts.
    """
    parts = [f"{prefix}0 AS (SELECT *, coalesce({text_expr}, '') AS t, CAST([] AS {TOKEN_LIST_TYPE}) AS toks FROM {src})"]
    prev = f"{prefix}0"
    for i, d in enumerate(detectors, start=1):
        p = q(re2_pattern(d))
        n = "n_" + d.entity.lower()
        parts.append(f"""{prefix}{i}a AS (SELECT *, regexp_extract_all(t, {p}) AS h FROM {prev})""")
        parts.append(f"""{prefix}{i}b AS (SELECT *, list_filter(list_filter(h, lambda x, j: list_position(h, x) = j),
              lambda x: NOT list_contains(list_transform(toks, lambda y: y.value), x)) AS nv FROM {prefix}{i}a)""")
        parts.append(f"""{prefix}{i}c AS (SELECT * EXCLUDE (toks, nv),
              list_concat(toks, list_transform(nv, lambda v, j: {{'token': printf('[{d.entity}_%04d]', j), 'value': v, 'entity': {q(d.entity)}}})) AS toks,
              len(nv)::INTEGER AS {n} FROM {prefix}{i}b)""")
        parts.append(f"""{prefix}{i} AS (SELECT * EXCLUDE (t, h),
              CASE WHEN len(h) > 0 THEN array_to_string(list_transform(string_split_regex(t, {p}),
                     lambda g, j: g || coalesce(list_transform(h, lambda x: toks[list_position(list_transform(toks, lambda y: y.value), x)].token)[j], '')), '')
                   ELSE t END AS t FROM {prefix}{i}c)""")
        prev = f"{prefix}{i}"
    return ",\n".join(parts), prev


def n_cols(alias: str = "") -> list[str]:
    pre = f"{alias}." if alias else ""
    return [f"{pre}n_{d.entity.lower()}" for d in DETECTORS]


def total_expr(alias: str = "") -> str:
    return "(" + " + ".join(n_cols(alias)) + ")"


def present_list_expr(alias: str = "") -> str:
    """List of lower-case types with a positive count."""
    pre = f"{alias}." if alias else ""
    items = ", ".join(f"CASE WHEN {pre}n_{d.entity.lower()} > 0 THEN {q(d.entity.lower())} END" for d in DETECTORS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def stats_long_select(rel: str, id_cols: str) -> str:
    """UNION ALL of (ids, entity, n) rows with n > 0."""
    sel = []
    for d in DETECTORS:
        n = "n_" + d.entity.lower()
        sel.append(f"SELECT {id_cols}, {q(d.entity.lower())} AS entity, {n}::BIGINT AS n FROM {rel} WHERE {n} > 0")
    return "\nUNION ALL ".join(sel)
