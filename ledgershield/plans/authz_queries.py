"""Authorisation and AP-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import AP_TENANT_RE, SOVEREIGN_TENANT_RE
from ..operators import authz as AZ
from ..sources import domain as D
from .oracle_common import q
from .registry import register

MODEL_REQ_CTE = """mreq AS (
  SELECT 'req_' || substr(sha256('model:' || o.o_orderkey::VARCHAR), 1, 16) AS request_id,
         't' || (o.o_custkey % 4)::VARCHAR AS principal_tenant,
         (o.o_orderkey % 23 <> 0) AS verified,
         CASE WHEN o.o_orderkey % 17 = 0 THEN ['audit:read'] ELSE ['model:invoke', 'audit:read'] END AS permissions,
         CASE WHEN o.o_orderkey % 29 = 0 THEN '-t' || (o.o_custkey % 4)::VARCHAR
              WHEN o.o_orderkey % 31 = 0 THEN 't' || ((o.o_custkey + 1) % 4)::VARCHAR
              ELSE 't' || (o.o_custkey % 4)::VARCHAR END AS tenant_id,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'restricted' WHEN '2-HIGH' THEN 'confidential'
              WHEN '3-MEDIUM' THEN 'internal' WHEN '4-NOT SPECIFIED' THEN 'public' ELSE 'unclassified' END AS data_class,
         CASE WHEN o.o_orderkey % 37 = 0 THEN '' WHEN o.o_orderstatus = 'F' THEN 'sealed'
              WHEN o.o_orderstatus = 'O' THEN 'gpt' ELSE 'claude' END AS requested_model,
         (o.o_orderkey % 19 <> 0) AS classification_complete,
         (o.o_totalprice < 300000) AS redaction_complete
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""

AUTH_CASE = f"""CASE WHEN NOT verified THEN 'unverified principal'
       WHEN NOT regexp_full_match(tenant_id, {q(SOVEREIGN_TENANT_RE[1:-1])}) THEN 'invalid tenant'
       WHEN principal_tenant <> tenant_id THEN 'cross-tenant access'
       WHEN NOT list_contains(permissions, 'model:invoke') THEN 'permission denied'"""


def _spol_sql() -> str:
    rows = []
    for t, models, classes, private, egress in D.sovereign_policy_catalog():
        rows.append(f"({q(t)}, [{', '.join(q(m) for m in models)}], [{', '.join(q(c) for c in classes)}], "
                    f"{q(private)}, {str(egress).upper()})")
    return "spol(tenant_id, models, classes, private_model, egress) AS (VALUES " + ", ".join(rows) + ")"


@register("authorize", "2.4", f"""WITH {MODEL_REQ_CTE}
SELECT request_id, ({AUTH_CASE} END) IS NULL AS allowed, {AUTH_CASE} END AS deny_reason FROM mreq""")
def authorize(spark, sf_dir):
    return AZ.authorize(D.model_requests(spark, sf_dir)).select("request_id", "allowed", "deny_reason")


_ROUTE_CASE = f"""{AUTH_CASE}
       WHEN NOT classification_complete THEN 'classification incomplete'
       WHEN data_class NOT IN ('public', 'internal', 'confidential', 'restricted') THEN 'invalid data classification'
       WHEN requested_model = '' THEN 'missing model'
       WHEN requested_model = coalesce(private_model, 'sealed') THEN NULL
       WHEN NOT redaction_complete THEN 'redaction incomplete'
       WHEN NOT coalesce(egress, FALSE) THEN 'external model egress disabled'
       WHEN NOT coalesce(list_contains(models, requested_model), FALSE) THEN 'model not approved'
       WHEN NOT coalesce(list_contains(classes, data_class), FALSE) THEN 'data class not approved for external processing'
       END"""


@register("model_route", "2.4", f"""WITH {MODEL_REQ_CTE}, {_spol_sql()},
d AS (SELECT r.*, p.models, p.classes, p.private_model, p.egress FROM mreq r LEFT JOIN spol p USING (tenant_id))
SELECT request_id, ({_ROUTE_CASE}) IS NULL AS allowed, {_ROUTE_CASE} AS deny_reason,
       CASE WHEN ({_ROUTE_CASE}) IS NULL THEN requested_model END AS model FROM d""")
def model_route(spark, sf_dir):
    return AZ.model_route(D.model_requests(spark, sf_dir), D.sovereign_policies(spark)) \
        .select("request_id", "allowed", "deny_reason", "model")


@register("tenant_id_check", "2.2", f"""WITH {MODEL_REQ_CTE}
SELECT tenant_id, regexp_full_match(tenant_id, {q(SOVEREIGN_TENANT_RE[1:-1])}) AS gateway_valid,
       regexp_full_match(tenant_id, {q(AP_TENANT_RE[1:-1])}) AS ap_valid, count(*)::BIGINT AS n
FROM mreq GROUP BY tenant_id""")
def tenant_id_check(spark, sf_dir):
    """Both tenant-id rules side by side (the gateway one needs an alphanumeric first char)."""
    r = D.model_requests(spark, sf_dir)
    return (r.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
            .select("tenant_id", AZ.full_match(F.col("tenant_id"), SOVEREIGN_TENANT_RE).alias("gateway_valid"),
                    AZ.full_match(F.col("tenant_id"), AP_TENANT_RE).alias("ap_valid"), "n"))


CONTRACTS_CTE = """contracts AS (
  SELECT 'ap-' || s_suppkey::VARCHAR AS agent_id,
         CASE WHEN s_suppkey % 23 = 0 THEN 'bad tenant!' ELSE 't' || (s_suppkey % 4)::VARCHAR END AS tenant_id,
         CASE s_suppkey % 3 WHEN 0 THEN ['payment.propose', 'invoice.extract']
              WHEN 1 THEN ['invoice.validate', 'purchase_order.match', 'gl_coding.propose'] ELSE []::VARCHAR[] END AS allowed_actions,
         (s_suppkey % 31 = 0) AS may_approve, (s_acctbal > 9900) AS may_release_payment
  FROM supplier),
cchk AS (
  SELECT *, CASE WHEN NOT regexp_full_match(tenant_id, '[A-Za-z0-9_-]{1,64}') THEN 'invalid tenant identifier'
                 WHEN may_approve OR may_release_payment THEN 'AP worker agents cannot approve or release payments' END AS reason
  FROM contracts)"""


@register("ap_contract_check", "2.2", f"""WITH {CONTRACTS_CTE}
SELECT agent_id, tenant_id, reason IS NULL AS valid, reason FROM cchk""")
def ap_contract_check(spark, sf_dir):
    return AZ.check_contracts(D.ap_contracts(spark, sf_dir)).select("agent_id", "tenant_id", "valid", "reason")


PROPOSALS_CTE = """props AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS proposal_id,
         'ap-' || l_suppkey::VARCHAR AS agent_id,
         CASE WHEN l_linenumber = 7 THEN 't' || ((l_suppkey + 1) % 4)::VARCHAR ELSE 't' || (l_suppkey % 4)::VARCHAR END AS tenant_id,
         CASE WHEN l_partkey % 41 = 0 THEN '' ELSE 'INV-' || l_orderkey::VARCHAR END AS invoice_id,
         CASE l_partkey % 5 WHEN 0 THEN 'invoice.extract' WHEN 1 THEN 'invoice.validate' WHEN 2 THEN 'purchase_order.match'
              WHEN 3 THEN 'gl_coding.propose' ELSE 'payment.propose' END AS action,
         CASE WHEN l_partkey % 53 = 0 THEN 'NaN' WHEN l_partkey % 59 = 0 THEN '-' || l_extendedprice::DECIMAL(18,2)::VARCHAR
              ELSE l_extendedprice::DECIMAL(18,2)::VARCHAR END AS amount_raw,
         CASE WHEN l_suppkey % 43 = 0 THEN 'chf' WHEN l_suppkey % 3 = 0 THEN 'CHF' WHEN l_suppkey % 3 = 1 THEN 'EUR' ELSE 'USD' END AS currency,
         'EV-' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS evidence_id,
         CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR END AS idempotency_key
  FROM lineitem)"""


@register("ap_proposal_check", "2.2", f"""WITH {CONTRACTS_CTE}, {PROPOSALS_CTE},
j AS (SELECT p.*, c.tenant_id AS c_tenant, c.allowed_actions AS c_actions, c.reason IS NULL AND c.agent_id IS NOT NULL AS c_valid,
             TRY_CAST(p.amount_raw AS DOUBLE) AS amount
      FROM props p LEFT JOIN cchk c USING (agent_id)),
r AS (SELECT *, CASE WHEN NOT c_valid THEN 'no valid contract'
                     WHEN tenant_id <> c_tenant THEN 'cross-tenant AP proposal'
                     WHEN NOT coalesce(list_contains(c_actions, action), FALSE) THEN 'action not authorised'
                     WHEN amount IS NULL OR NOT isfinite(amount) OR amount < 0 THEN 'invalid amount'
                     WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'invalid currency'
                     WHEN coalesce(invoice_id, '') = '' OR coalesce(evidence_id, '') = '' OR coalesce(idempotency_key, '') = ''
                          THEN 'missing evidence or idempotency reference' END AS reason FROM j)
SELECT proposal_id, agent_id, CASE WHEN isfinite(amount) THEN amount END AS amount, reason IS NULL AS valid, reason FROM r""")
def ap_proposal_check(spark, sf_dir):
    r = AZ.check_proposals(D.ap_proposals(spark, sf_dir), D.ap_contracts(spark, sf_dir))
    return r.select("proposal_id", "agent_id", F.col("amount").cast("double").alias("amount"), "valid", "reason")


@register("join_contract", "2.5", f"""WITH {CONTRACTS_CTE}, {PROPOSALS_CTE}
SELECT c.agent_id, count(p.proposal_id)::BIGINT AS n_proposals,
       count(p.proposal_id) FILTER (WHERE p.tenant_id = c.tenant_id)::BIGINT AS n_same_tenant
FROM contracts c LEFT JOIN props p USING (agent_id) GROUP BY c.agent_id""")
def join_contract(spark, sf_dir):
    c = D.ap_contracts(spark, sf_dir).select("agent_id", F.col("tenant_id").alias("c_tenant"))
    p = D.ap_proposals(spark, sf_dir).select("agent_id", "proposal_id", "tenant_id")
    # pre-aggregate proposals per agent (map-side combine) before the join
    per = p.join(c, "agent_id").groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("n_proposals"),
        F.count(F.when(F.col("tenant_id") == F.col("c_tenant"), 1)).alias("n_same_tenant"))
    return (c.join(per, "agent_id", "left")
            .select("agent_id", F.coalesce("n_proposals", F.lit(0)).cast("bigint").alias("n_proposals"),
                    F.coalesce("n_same_tenant", F.lit(0)).cast("bigint").alias("n_same_tenant")))
