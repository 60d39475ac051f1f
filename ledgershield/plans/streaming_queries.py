"""Streaming queries (run to the end of the available input, then read back)."""

from __future__ import annotations

from ..streaming import jobs as S
from .audit_queries import ENTRIES_CTE
from .authz_queries import PROPOSALS_CTE
from .registry import REGISTRY, register

# the stateless stream must equal the batch decision
_ROUTE_SQL = REGISTRY["route_decision"].sql


@register("stream_redact_route", "2.11", _ROUTE_SQL)
def stream_redact_route(spark, sf_dir):
    return S.stream_redact_route(spark, sf_dir)


@register("stream_kpi_daily", "2.11", f"""WITH {ENTRIES_CTE}
SELECT e.ts::DATE AS day, count(*) AS calls, count(*) FILTER (WHERE c.tier = 'public') AS public,
       count(*) FILTER (WHERE c.tier = 'private') AS private, count(*) FILTER (WHERE c.tier = 'sealed') AS sealed,
       sum(c.kv % 3 + c.kv % 2)::BIGINT AS entities
FROM calls c JOIN events e ON e.event_id = c.seq GROUP BY 1""")
def stream_kpi_daily(spark, sf_dir):
    return S.stream_kpi_daily(spark, sf_dir)


@register("stream_audit_chain", "2.11", REGISTRY["chain_link"].sql)
def stream_audit_chain(spark, sf_dir):
    """One chain per tenant, equal to the chains that the batch job links."""
    return S.stream_audit_chain(spark, sf_dir).select("tenant", "seq_in_log", "request_id", "hash", "prev_hash")


@register("stream_dedupe", "2.11", f"""WITH {PROPOSALS_CTE}
SELECT DISTINCT idempotency_key FROM props WHERE idempotency_key IS NOT NULL""")
def stream_dedupe(spark, sf_dir):
    return S.stream_dedupe(spark, sf_dir)
