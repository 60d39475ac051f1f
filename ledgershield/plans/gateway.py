"""Gateway queries: detection, redaction, rehydration, routing, request shaping.

Each function takes (spark, sf_dir) and returns a lazy DataFrame; the SQL next
to it is the DuckDB oracle for the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_MAX_TOKENS, DEFAULT_MODEL, DETECTORS, re2_pattern
from ..operators import redaction as RD
from ..operators import routing as RT
from ..session import written
from ..sources import domain as D
from ..sources.tables import table
from .oracle_common import (CORPUS_CTE, PROMPTS_CTE, n_cols, present_list_expr, q, redaction_ctes,
                            stats_long_select, total_expr)
from .registry import register

N_COLS = [f"n_{d.entity.lower()}" for d in DETECTORS]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts to scan: prompts, documents and raw pages (kind, id, text)."""
    p = D.prompt_requests(spark, sf_dir).select(F.lit("prompt").alias("kind"), F.col("o_orderkey").alias("id"), "text")
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    g = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                              F.col("html").alias("text"))
    return p.unionByName(d).unionByName(g)


def _corpus_redacted(spark, sf_dir):
    return RD.redact_text(corpus(spark, sf_dir), "text")


# ------------------------------------------------------------ detectors -----

def _detect_sql(d) -> str:
    return f"""WITH {CORPUS_CTE},
h AS (SELECT kind, id, regexp_extract_all(coalesce(text, ''), {q(re2_pattern(d))}) AS h FROM corpus)
SELECT kind, id, len(h)::BIGINT AS n_hits, len(list_distinct(h))::BIGINT AS n_distinct,
       array_to_string(h, '|') AS hits
FROM h WHERE len(h) > 0"""


def _make_detect(d, key):
    def build(spark, sf_dir, _e=d.entity):
        return RD.detect_entities(corpus(spark, sf_dir), ["kind", "id"], "text", _e)
    build.__name__ = key
    register(key, "2.3", _detect_sql(d))(build)


for _key, _ent in [("detect_swiss_acct", "SWISS_ACCT"), ("detect_payment_ref", "SYGNUM_REF"),
                   ("detect_iban", "IBAN"), ("detect_card", "CC"), ("detect_email", "EMAIL"),
                   ("detect_amount", "AMOUNT"), ("detect_vendor", "VENDOR")]:
    _make_detect(RD.detector(_ent), _key)


# ------------------------------------------------------------ redaction -----

_RED_CORPUS, _RED_CORPUS_LAST = redaction_ctes("corpus", "text", "rc")


@register("redact_text", "2.3", f"""WITH {CORPUS_CTE},
{_RED_CORPUS}
SELECT kind, id, t AS redacted_text, {total_expr()}::INTEGER AS n_entities, {', '.join(n_cols())}, 'regex' AS backend
FROM {_RED_CORPUS_LAST}""")
def redact_text(spark, sf_dir):
    r = _corpus_redacted(spark, sf_dir)
    return r.select("kind", "id", "redacted_text", "n_entities", *N_COLS, "backend")


@register("redaction_stats", "2.3", f"""WITH {CORPUS_CTE},
{_RED_CORPUS}
{stats_long_select(_RED_CORPUS_LAST, "kind, id")}""")
def redaction_stats(spark, sf_dir):
    return RD.stats_long(_corpus_redacted(spark, sf_dir), ["kind", "id"])


@register("rehydration_map", "2.3", f"""WITH {CORPUS_CTE},
{_RED_CORPUS}
SELECT kind, id, x.token AS token, x.value AS value, x.entity AS entity
FROM (SELECT kind, id, unnest(toks) AS x FROM {_RED_CORPUS_LAST})""")
def rehydration_map(spark, sf_dir):
    return RD.tokens_long(_corpus_redacted(spark, sf_dir), ["kind", "id"])


@register("entity_corpus_stats", "2.3", f"""WITH {CORPUS_CTE},
{_RED_CORPUS},
s AS ({stats_long_select(_RED_CORPUS_LAST, "kind, id")})
SELECT entity, count(*)::BIGINT AS n_texts, sum(n)::BIGINT AS n_values FROM s GROUP BY entity""")
def entity_corpus_stats(spark, sf_dir):
    return RD.entity_corpus_stats(_corpus_redacted(spark, sf_dir))


_RED_PROMPTS, _RED_PROMPTS_LAST = redaction_ctes("prompts", "text", "rp")


@register("sensitivity_total", "2.3", f"""WITH {PROMPTS_CTE},
{_RED_PROMPTS}
SELECT request_id, {total_expr()}::INTEGER AS total FROM {_RED_PROMPTS_LAST}""")
def sensitivity_total(spark, sf_dir):
    from ..functions.redact import sensitivity_total as st
    r = RD.redact_text(D.prompt_requests(spark, sf_dir), "text")
    return r.select("request_id", st(F.col("stats")).cast("int").alias("total"))


@register("rehydrate", "2.3", f"""WITH {PROMPTS_CTE}
SELECT request_id, 'Seen: ' || text || ' [EMAIL_9999]' AS text FROM prompts""")
def rehydrate(spark, sf_dir):
    """Responses echo the redacted prompt plus an unknown token; rehydration
    must give back the original prompt and leave the unknown token alone."""
    key = KEY
    # written: the responses and the token map both read the redacted prompts, which are redacted once
    r = written(RD.redact_text(D.prompt_requests(spark, sf_dir), "text").select(*key, "redacted_text", "tokens"), "redacted-prompts")
    responses = r.select("o_orderkey", "request_id", F.concat(F.lit("Seen: "), F.col("redacted_text"),
                                                F.lit(" [EMAIL_9999]")).alias("text"))
    toks = RD.tokens_long(r, key)
    return RD.rehydrate(responses, toks, key).drop("o_orderkey")


KEY = ["o_orderkey", "request_id"]      # the short id alone is a label: two requests may share it


def prompt_messages(spark, sf_dir) -> DataFrame:
    """Three messages per prompt request; the follow-up names a second vendor so
    per-message token numbering collides ([VENDOR_0001] twice)."""
    p = D.prompt_requests(spark, sf_dir)
    k = F.col("o_orderkey")
    follow = F.concat(F.lit("Follow-up: also Vendor"), (k % 89 + 1000).cast("string"),
                      F.lit(" AG and CHF "), (k % 9000 + 1000).cast("string"), F.lit("."))
    def message(turn, role, text):
        return F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    # one pass over the prompts: a union of three would join the orders to their customers three times
    three = F.array(message(0, "user", F.col("text")), message(1, "assistant", F.lit("Noted.")), message(2, "user", follow))
    return p.select(*KEY, F.inline(three))


PROMPT_MESSAGES_CTE = PROMPTS_CTE + """,
msgs AS (
  SELECT request_id, 0 AS turn, 'user' AS role, text FROM prompts
  UNION ALL SELECT request_id, 1 AS turn, 'assistant' AS role, 'Noted.' AS text FROM prompts
  UNION ALL SELECT request_id, 2 AS turn, 'user' AS role,
         'Follow-up: also Vendor' || (o_orderkey % 89 + 1000)::VARCHAR || ' AG and CHF ' || (o_orderkey % 9000 + 1000)::VARCHAR || '.' AS text
  FROM prompts
)"""
_RED_MSGS, _RED_MSGS_LAST = redaction_ctes("msgs", "text", "rm")


@register("redact_messages", "2.3", f"""WITH {PROMPT_MESSAGES_CTE},
{_RED_MSGS},
s AS ({stats_long_select(_RED_MSGS_LAST, "request_id, turn")})
SELECT request_id, entity, sum(n)::BIGINT AS n FROM s GROUP BY request_id, entity""")
def redact_messages(spark, sf_dir):
    r = RD.redact_messages(prompt_messages(spark, sf_dir), KEY)
    return RD.merged_stats(r, KEY).drop("o_orderkey")


@register("rehydration_merge", "2.3", f"""WITH {PROMPT_MESSAGES_CTE},
{_RED_MSGS},
x AS (SELECT request_id, turn, unnest(toks) AS t FROM {_RED_MSGS_LAST})
SELECT request_id, t.token AS token, arg_min(t.value, turn) AS value FROM x GROUP BY request_id, t.token""")
def rehydration_merge(spark, sf_dir):
    r = RD.redact_messages(prompt_messages(spark, sf_dir), KEY)
    return RD.merged_rehydration(r, KEY).drop("o_orderkey")


@register("request_token_map", "2.3", f"""WITH {PROMPT_MESSAGES_CTE},
{_RED_MSGS},
x AS (SELECT request_id, turn, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM {_RED_MSGS_LAST}),
f AS (SELECT request_id, t.entity AS entity, t.value AS value, min(turn * 1000000 + pos) AS first
      FROM x GROUP BY request_id, t.entity, t.value)
SELECT request_id, entity, value,
       printf('[%s_%04d]', entity, row_number() OVER (PARTITION BY request_id, entity ORDER BY first)) AS token
FROM f""")
def request_token_map(spark, sf_dir):
    r = RD.redact_messages(prompt_messages(spark, sf_dir), KEY)
    return RD.request_token_map(r, KEY).drop("o_orderkey")


_RED_NULL, _RED_NULL_LAST = redaction_ctes(
    "(SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE text END AS txt FROM conversations)", "txt", "rn")


@register("redact_null_safe", "2.3", f"""WITH {_RED_NULL}
SELECT conv_id, turn, t AS redacted_text, {total_expr()}::INTEGER AS n_entities FROM {_RED_NULL_LAST}""")
def redact_null_safe(spark, sf_dir):
    cv = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("text")).alias("txt"))
    return RD.redact_text(cv, "txt").select("conv_id", "turn", "redacted_text", "n_entities")


# -------------------------------------------------------------- routing -----

def _policy_values_sql() -> tuple[str, str]:
    """VALUES lists for the policy and rule tables of the test tenants."""
    pol, rules = [], []
    for tenant, doc in sorted(D.policy_catalog().items()):
        t, name, default_tier, allow, rows, found = RT._policy_row(tenant, doc)
        pol.append(f"({q(t)}, {q(name)}, {q(default_tier)}, {str(allow).upper()}, {str(found).upper()})")
        for n, ents, thr, tier, _ in rows:
            ent_sql = "[" + ", ".join(q(e) for e in ents) + "]" if ents else "NULL::VARCHAR[]"
            rules.append(f"({q(t)}, {n}, {ent_sql}, {thr if thr is not None else 'NULL::INTEGER'}, "
                         f"{q(tier) if tier else 'NULL::VARCHAR'})")
    pol_sql = ("policy(tenant, name, default_tier, allow_override, policy_found) AS (VALUES "
               + ", ".join(pol) + ")")
    rules_sql = ("rules(tenant, rule_no, entity_in, max_gt, then_tier) AS (VALUES " + ", ".join(rules) + ")")
    return pol_sql, rules_sql


_POL_SQL, _RULES_SQL = _policy_values_sql()

ROUTE_CTES = f"""{PROMPTS_CTE},
{_RED_PROMPTS},
{_POL_SQL},
{_RULES_SQL},
req AS (SELECT request_id, tenant, explicit_tier, {total_expr()} AS total, {present_list_expr()} AS present
        FROM {_RED_PROMPTS_LAST}),
cond AS (
  SELECT r.request_id, u.rule_no, u.then_tier,
         (u.entity_in IS NOT NULL AND len(u.entity_in) > 0
          AND len(list_filter(list_transform(u.entity_in, lambda x: lower(x)), lambda x: list_contains(r.present, x))) > 0) AS ent_ok,
         (u.max_gt IS NOT NULL AND r.total > u.max_gt) AS thr_ok
  FROM req r JOIN rules u ON u.tenant = r.tenant),
fired AS (SELECT request_id, rule_no, then_tier FROM cond WHERE then_tier IS NOT NULL AND (ent_ok OR thr_ok)),
firstm AS (SELECT request_id, min(rule_no) AS rule_no FROM fired GROUP BY request_id),
firstr AS (SELECT f.request_id, f.rule_no, f.then_tier FROM fired f JOIN firstm m USING (request_id, rule_no)),
decision AS (
  SELECT r.request_id, r.tenant,
         CASE WHEN r.explicit_tier IS NOT NULL AND r.explicit_tier <> '' AND coalesce(p.allow_override, FALSE) THEN r.explicit_tier
              WHEN fr.rule_no IS NOT NULL THEN fr.then_tier ELSE coalesce(p.default_tier, 'public') END AS tier,
         CASE WHEN r.explicit_tier IS NOT NULL AND r.explicit_tier <> '' AND coalesce(p.allow_override, FALSE) THEN 'override'
              WHEN fr.rule_no IS NOT NULL THEN 'rule' ELSE 'default' END AS reason,
         CASE WHEN r.explicit_tier IS NOT NULL AND r.explicit_tier <> '' AND coalesce(p.allow_override, FALSE) THEN NULL
              ELSE fr.rule_no END AS rule_no,
         (r.explicit_tier IS NOT NULL AND r.explicit_tier <> '' AND NOT coalesce(p.allow_override, FALSE)) AS override_denied,
         coalesce(p.policy_found, FALSE) AS policy_found
  FROM req r LEFT JOIN policy p ON p.tenant = r.tenant LEFT JOIN firstr fr ON fr.request_id = r.request_id)"""


def _routed(spark, sf_dir) -> DataFrame:
    reqs = RD.redact_text(D.prompt_requests(spark, sf_dir), "text") \
        .select("request_id", "tenant", "explicit_tier", "stats")
    pol = RT.policies_from_docs(spark, D.policy_catalog())
    return RT.route(reqs, pol)


def _policies(spark):
    return RT.policies_from_docs(spark, D.policy_catalog())


def _redacted_requests(spark, sf_dir):
    return RD.redact_text(D.prompt_requests(spark, sf_dir), "text").select(
        *KEY, "tenant", "explicit_tier", "stats")


@register("route_decision", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, tenant, tier, reason, rule_no::INTEGER AS rule_no, override_denied, policy_found,
       tier IN ('public', 'private', 'sealed') AS tier_valid FROM decision""")
def route_decision(spark, sf_dir):
    return _routed(spark, sf_dir).select("request_id", "tenant", "tier", "reason", "rule_no",
                                         "override_denied", "policy_found", "tier_valid")


@register("route_first_match", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, rule_no::INTEGER AS rule_no, then_tier AS tier FROM firstr""")
def route_first_match(spark, sf_dir):
    """First firing rule per request, ignoring any override."""
    r = RT.route(_redacted_requests(spark, sf_dir).withColumn("explicit_tier", F.lit(None).cast("string")),
                 _policies(spark))
    return r.where(F.col("reason") == "rule").select("request_id", "rule_no", "tier")


@register("route_default", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, tenant, tier FROM decision WHERE reason = 'default'""")
def route_default(spark, sf_dir):
    return _routed(spark, sf_dir).where(F.col("reason") == "default").select("request_id", "tenant", "tier")


@register("route_override", "2.4", f"""WITH {ROUTE_CTES}
SELECT d.request_id, r.explicit_tier, d.reason = 'override' AS honoured, d.tier
FROM decision d JOIN req r USING (request_id) WHERE r.explicit_tier IS NOT NULL AND r.explicit_tier <> ''""")
def route_override(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return (r.where(F.col("explicit_tier").isNotNull() & (F.col("explicit_tier") != ""))
            .select("request_id", "explicit_tier", (F.col("reason") == "override").alias("honoured"), "tier"))


@register("route_reason", "2.4", f"""WITH {ROUTE_CTES}
SELECT tenant, reason, count(*)::BIGINT AS n FROM decision GROUP BY tenant, reason""")
def route_reason(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("tenant", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("rule_match", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, rule_no::INTEGER AS rule_no, then_tier FROM fired""")
def rule_match(spark, sf_dir):
    return RT.fired_rules(_redacted_requests(spark, sf_dir), _policies(spark), which="any") \
        .select("request_id", "rule_no", "then_tier")


@register("rule_entity_in", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, rule_no::INTEGER AS rule_no FROM cond WHERE ent_ok""")
def rule_entity_in(spark, sf_dir):
    return RT.fired_rules(_redacted_requests(spark, sf_dir), _policies(spark), which="entity") \
        .select("request_id", "rule_no")


@register("rule_max_entities", "2.4", f"""WITH {ROUTE_CTES}
SELECT request_id, rule_no::INTEGER AS rule_no FROM cond WHERE thr_ok""")
def rule_max_entities(spark, sf_dir):
    return RT.fired_rules(_redacted_requests(spark, sf_dir), _policies(spark), which="threshold") \
        .select("request_id", "rule_no")


@register("join_policy", "2.5", f"""WITH {PROMPTS_CTE},
{_POL_SQL},
{_RULES_SQL},
nr AS (SELECT tenant, count(*) AS n FROM rules GROUP BY tenant)
SELECT r.request_id, r.tenant, coalesce(p.name, r.tenant) AS policy_name, coalesce(p.default_tier, 'public') AS default_tier,
       coalesce(p.allow_override, FALSE) AS allow_override, coalesce(nr.n, 0)::INTEGER AS n_rules
FROM prompts r LEFT JOIN policy p ON p.tenant = r.tenant LEFT JOIN nr ON nr.tenant = r.tenant""")
def join_policy(spark, sf_dir):
    j = RT.with_policy(D.prompt_requests(spark, sf_dir).select("request_id", "tenant"), _policies(spark))
    return j.select("request_id", "tenant", "policy_name", "default_tier", "allow_override",
                    F.size("rules").cast("int").alias("n_rules"))


@register("tier_validity", "2.2", f"""WITH {ROUTE_CTES}
SELECT request_id, tier, 'unknown tier: ' || tier AS error FROM decision
WHERE tier NOT IN ('public', 'private', 'sealed')""")
def tier_validity(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return r.where(~F.col("tier_valid")).select("request_id", "tier",
                                                F.concat(F.lit("unknown tier: "), F.col("tier")).alias("error"))


@register("tier_breakdown", "2.6", f"""WITH {ROUTE_CTES}
SELECT coalesce(tier, '?') AS tier, count(*)::BIGINT AS n FROM decision GROUP BY 1""")
def tier_breakdown(spark, sf_dir):
    return RT.tier_breakdown(_routed(spark, sf_dir))


# ----------------------------------------------------- request shaping -----

@register("last_user_text", "2.2", """
SELECT 'req_' || substr(sha256('conv:' || conv_id::VARCHAR), 1, 16) AS request_id,
       coalesce(arg_max(CASE WHEN (conv_id + turn) % 7 = 6 THEN '' ELSE coalesce(text, '') END, turn) FILTER (WHERE role = 'user'), '')
         AS last_user_text,
       count(*)::BIGINT AS n_messages
FROM conversations GROUP BY conv_id""")
def last_user_text(spark, sf_dir):
    """Only the last user message of a request is classified: '' if there is none or its content is not text."""
    m = D.chat_messages(spark, sf_dir)
    of_user = F.when(F.col("role") == "user", F.col("turn"))
    text = F.when(F.col("block_type") == "text", F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    return (m.groupBy("conv_id", "request_id")
            .agg(F.coalesce(F.max_by(F.when(F.col("role") == "user", text), of_user), F.lit("")).alias("last_user_text"),
                 F.count(F.lit(1)).alias("n_messages")).drop("conv_id"))


@register("request_defaults", "2.2", f"""WITH {PROMPTS_CTE}
SELECT request_id, coalesce(nullif(model, ''), {q(DEFAULT_MODEL)}) AS model,
       coalesce(max_tokens, {DEFAULT_MAX_TOKENS})::INTEGER AS max_tokens,
       coalesce(nullif(tenant, ''), 'demo') AS tenant FROM prompts""")
def request_defaults(spark, sf_dir):
    p = D.prompt_requests(spark, sf_dir)
    return p.select("request_id",
                    F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(DEFAULT_MODEL)).alias("model"),
                    F.coalesce(F.col("max_tokens"), F.lit(DEFAULT_MAX_TOKENS)).cast("int").alias("max_tokens"),
                    F.coalesce(F.nullif(F.col("tenant"), F.lit("")), F.lit("demo")).alias("tenant"))


@register("text_preview", "2.2", f"""WITH {PROMPTS_CTE}
SELECT request_id,
       CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS preview,
       left(text, 200) AS preview_200, length(text)::INTEGER AS n_chars FROM prompts""")
def text_preview(spark, sf_dir):
    p = D.prompt_requests(spark, sf_dir)
    t = F.col("text")
    return p.select("request_id",
                    F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 80), F.lit("…"))).otherwise(t).alias("preview"),
                    F.substring(t, 1, 200).alias("preview_200"), F.length(t).cast("int").alias("n_chars"))


@register("usage_map", "2.2", f"""WITH {PROMPT_MESSAGES_CTE},
{_RED_MSGS},
s AS ({stats_long_select(_RED_MSGS_LAST, "request_id, turn")}),
per AS (SELECT request_id, entity, sum(n) AS n FROM s GROUP BY request_id, entity)
SELECT request_id, 'redacted_' || entity AS key, n::BIGINT AS value FROM per
UNION ALL
SELECT request_id, 'entities_redacted' AS key, coalesce(sum(n), 0)::BIGINT AS value
FROM (SELECT DISTINCT request_id FROM msgs) r LEFT JOIN per USING (request_id) GROUP BY request_id""")
def usage_map(spark, sf_dir):
    """Usage map of the multi-message tier: entities_redacted = sum of stats,
    plus each stat re-keyed redacted_<type>; as (request_id, key, value) rows."""
    msgs = prompt_messages(spark, sf_dir)
    r = RD.redact_messages(msgs, KEY)
    per = (r.groupBy(*KEY)
           .agg(F.sum("n_entities").cast("bigint").alias("total"),
                *[F.sum(c).cast("bigint").alias(c) for c in N_COLS]))
    m = F.map_concat(
        F.map_from_entries(F.filter(F.array(*[F.struct(F.lit("redacted_" + c[2:]).alias("k"), F.col(c).alias("v"))
                                              for c in N_COLS]), lambda e: e["v"] > 0)),
        F.create_map(F.lit("entities_redacted"), F.col("total")))
    return per.select("request_id", F.explode(m).alias("key", "value"))


@register("account_mask", "2.2", """
SELECT 'ACC' || c_custkey::VARCHAR AS account_number,
       CASE WHEN c_custkey % 10 = 0 THEN '(no account number)'
            ELSE '*' || right(lpad(c_custkey::VARCHAR, 6, '0') || lpad(c_nationkey::VARCHAR, 4, '0'), 4) END AS account_no_masked
FROM customer""")
def account_mask(spark, sf_dir):
    a = D.cash_accounts(spark, sf_dir)
    no = F.col("account_no")
    return a.select("account_number",
                    F.when(F.coalesce(F.trim(no), F.lit("")) == "", F.lit("(no account number)"))
                    .otherwise(F.concat(F.lit("*"), F.substring(no, -4, 4))).alias("account_no_masked"))
