"""Audit-log queries: append, link, write/scan, verify, recent, KPIs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..session import scratch_path
from ..sources import domain as D
from ..sources.tables import table
from .registry import register

AS_OF_DAY = "2024-01-15"
LAST_DAY = "2024-01-30"
TAMPER_MOD, TAMPER_AT = 997, 500


def _js(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || {x} || '"' END"""


ENTRIES_CTE = f"""calls AS (
  SELECT event_id AS seq,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp,
         't' || (user_id % 4)::VARCHAR AS tenant,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'u' || user_id::VARCHAR END AS "user",
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'private' WHEN event_type = 'error' THEN 'sealed' ELSE 'public' END AS tier,
         'model-a' AS model,
         'req_' || substr(sha256('event:' || event_id::VARCHAR), 1, 16) AS request_id,
         sha256(coalesce(props, '')) AS prompt_hash,
         CASE WHEN event_type IN ('purchase', 'signup') THEN sha256('redacted ' || props) END AS redacted_prompt_hash,
         CASE WHEN event_type = 'error' OR value < 1 THEN NULL ELSE sha256('answer ' || value::DECIMAL(12,2)::VARCHAR) END AS response_hash,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS kv,
         trunc(value * 10)::INTEGER AS duration_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' THEN 'upstream failure ' || json_extract_string(props, '$.k') END AS error,
         'gw-host-1' AS host
  FROM events),
bodies AS (
  SELECT *, '{{"duration_ms":' || duration_ms::VARCHAR || ',"error":' || {_js('error')} || ',"host":' || {_js('host')}
         || ',"model":' || {_js('model')} || ',"prompt_hash":' || {_js('prompt_hash')}
         || ',"redacted_prompt_hash":' || {_js('redacted_prompt_hash')}
         || ',"redaction_stats":{{' || concat_ws(',', CASE WHEN kv % 3 > 0 THEN '"email":' || (kv % 3)::VARCHAR END,
                                                CASE WHEN kv % 2 > 0 THEN '"vendor":' || (kv % 2)::VARCHAR END) || '}}'
         || ',"request_id":' || {_js('request_id')} || ',"response_hash":' || {_js('response_hash')}
         || ',"status":' || {_js('status')} || ',"tenant":' || {_js('tenant')} || ',"tier":' || {_js('tier')}
         || ',"timestamp":' || {_js('timestamp')} || ',"user":' || {_js('"user"')} || '}}' AS body
  FROM calls),
entries AS (
  SELECT *, sha256(body) AS hash FROM bodies),
chained AS (
  SELECT *, lag(hash) OVER (ORDER BY seq) AS prev_hash FROM entries)"""


def _entries(spark, sf_dir):
    return AU.build_entries(D.audit_calls(spark, sf_dir))


def _entries_of(spark, sf_dir, day: str):
    """Entries of one day: the day is a range of the event time, which reaches the scan."""
    return AU.build_entries(D.audit_calls(spark, sf_dir, AU.on_day(table(spark, sf_dir, "events"), day)))


def _chained(spark, sf_dir):
    return AU.link_chain(_entries(spark, sf_dir), [])


@register("audit_append", "2.1", f"""WITH {ENTRIES_CTE}
SELECT seq, request_id, prompt_hash, redacted_prompt_hash, response_hash, hash, prev_hash FROM chained""")
def audit_append(spark, sf_dir):
    return _chained(spark, sf_dir).select("seq", "request_id", "prompt_hash", "redacted_prompt_hash",
                                          "response_hash", "hash", "prev_hash")


@register("audit_projection", "2.2", f"""WITH {ENTRIES_CTE}
SELECT request_id, tenant, "user", tier, status, error, duration_ms, prompt_hash, redacted_prompt_hash, response_hash
FROM entries""")
def audit_projection(spark, sf_dir):
    return _entries(spark, sf_dir).select("request_id", "tenant", "user", "tier", "status", "error",
                                          "duration_ms", "prompt_hash", "redacted_prompt_hash", "response_hash")


@register("chain_link", "2.7", f"""WITH {ENTRIES_CTE}
SELECT tenant, (row_number() OVER (PARTITION BY tenant ORDER BY seq) - 1)::BIGINT AS seq_in_log, request_id, hash,
       lag(hash) OVER (PARTITION BY tenant ORDER BY seq) AS prev_hash
FROM entries""")
def chain_link(spark, sf_dir):
    """Per-tenant logs: dense position within the tenant, then the self-join link."""
    e = AU.dense_seq(_entries(spark, sf_dir), ["tenant"], "seq", out_col="seq_in_log")
    e = e.drop("seq").withColumnRenamed("seq_in_log", "seq")
    return AU.link_chain(e, ["tenant"]).select("tenant", F.col("seq").alias("seq_in_log"), "request_id",
                                               "hash", "prev_hash")


def _written_shared_log(spark, sf_dir):
    path = scratch_path(spark, f"audit-log-{uuid.uuid4().hex}")
    AU.write_log(_chained(spark, sf_dir), path)
    return AU.scan_log(spark, path)


@register("audit_scan", "2.1", f"""WITH {ENTRIES_CTE}
SELECT seq, request_id, tier, hash, prev_hash FROM chained""")
def audit_scan(spark, sf_dir):
    """Write the log as JSON Lines in the shared folder, read it back in file order."""
    return _written_shared_log(spark, sf_dir).select("seq", "request_id", "tier", "hash", "prev_hash")


@register("audit_scan_corrupt", "2.1", f"""WITH {ENTRIES_CTE}
SELECT seq, seq % {TAMPER_MOD} = {TAMPER_AT} AS corrupt, CASE WHEN seq % {TAMPER_MOD} = {TAMPER_AT} THEN substr(body, 1, 18) END AS raw,
       CASE WHEN seq % {TAMPER_MOD} <> {TAMPER_AT} THEN request_id END AS request_id FROM chained""")
def audit_scan_corrupt(spark, sf_dir):
    """Some lines of the log are cut off: they come out marked, with the text that is left, and the others as they are."""
    e = _chained(spark, sf_dir)
    line = AU.entry_line(e)
    cut = e.select("seq", F.when(F.col("seq") % TAMPER_MOD == TAMPER_AT, F.substring(line, 1, 18)).otherwise(line).alias("value"))
    path = scratch_path(spark, f"audit-cut-{uuid.uuid4().hex}")
    AU.write_lines(cut, path, [])
    return AU.scan_log(spark, path).select("seq", "corrupt", F.when(F.col("corrupt"), F.col("raw")).alias("raw"), "request_id")


@register("audit_append_existing", "2.1", f"""WITH {ENTRIES_CTE}
SELECT count(*)::BIGINT AS n_entries, 0::BIGINT AS n_broken, TRUE AS ok, 1::BIGINT AS n_first,
       (SELECT arg_max(hash, seq) FROM entries) AS last_hash FROM entries""")
def audit_append_existing(spark, sf_dir):
    """Half of the calls (by median sequence number) are written, the others appended to that log; the
    whole verifies and has one entry without a predecessor."""
    e = _entries(spark, sf_dir)
    middle = e.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0] or 0
    path = scratch_path(spark, f"audit-append-{uuid.uuid4().hex}")
    AU.write_log(AU.link_chain(e.where(F.col("seq") <= middle), []), path)
    AU.append_log(e.where(F.col("seq") > middle), path)
    lines = AU.scan_log(spark, path)
    facts = lines.agg(F.count(F.when(F.col("prev_hash").isNull(), 1)).alias("n_first"), F.max_by("hash", "seq").alias("last_hash"))
    return AU.verify_chain(lines).select("n_entries", "n_broken", "ok").crossJoin(facts)


@register("chain_verify", "2.6", f"""WITH {ENTRIES_CTE}
SELECT count(*)::BIGINT AS n_entries, 0::BIGINT AS n_broken, NULL::BIGINT AS broken_at, TRUE AS ok FROM entries""")
def chain_verify(spark, sf_dir):
    return AU.verify_chain(_written_shared_log(spark, sf_dir)).select("n_entries", "n_broken", "broken_at", "ok")


@register("chain_verify_tampered", "2.7", f"""WITH {ENTRIES_CTE},
pos AS (SELECT tenant, seq, (row_number() OVER (PARTITION BY tenant ORDER BY seq) - 1) AS seq_in_log FROM entries)
SELECT tenant, count(*)::BIGINT AS n_entries,
       count(*) FILTER (WHERE seq % {TAMPER_MOD} = {TAMPER_AT})::BIGINT AS n_broken,
       min(seq_in_log) FILTER (WHERE seq % {TAMPER_MOD} = {TAMPER_AT})::BIGINT AS broken_at,
       count(*) FILTER (WHERE seq % {TAMPER_MOD} = {TAMPER_AT}) = 0 AS ok
FROM pos GROUP BY tenant""")
def chain_verify_tampered(spark, sf_dir):
    """Per-tenant logs where some entries were edited after hashing (duration
    changed); each edited entry must be reported, the first one as broken_at."""
    e = AU.dense_seq(_entries(spark, sf_dir), ["tenant"], "seq", out_col="seq_in_log", lay_out=True)
    e = AU.link_chain(e, ["tenant"], "seq_in_log")
    tampered = e.withColumn("duration_ms", F.when(F.col("seq") % TAMPER_MOD == TAMPER_AT, F.col("duration_ms") + 1)
                            .otherwise(F.col("duration_ms")))
    path = scratch_path(spark, f"audit-tenants-{uuid.uuid4().hex}")
    AU.write_log(tampered.drop("seq").withColumnRenamed("seq_in_log", "seq"), path, ["tenant"])
    lines = AU.scan_log(spark, path, ["tenant"])
    return AU.verify_chain(lines, ["tenant"]).select("tenant", "n_entries", "n_broken", "broken_at", "ok")


@register("tenant_log_split", "2.1", f"""WITH {ENTRIES_CTE}
SELECT tenant, count(*)::BIGINT AS n_entries, arg_max(hash, seq) AS last_hash FROM entries GROUP BY tenant""")
def tenant_log_split(spark, sf_dir):
    """One log folder per tenant (partitionBy), read back per tenant."""
    e = AU.dense_seq(_entries(spark, sf_dir), ["tenant"], "seq", out_col="seq_in_log")
    e = AU.link_chain(e.drop("seq").withColumnRenamed("seq_in_log", "seq"), ["tenant"])
    path = scratch_path(spark, f"audit-split-{uuid.uuid4().hex}")
    AU.write_log(e, path, ["tenant"])
    lines = AU.scan_log(spark, path, ["tenant"])
    return (lines.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_entries"),
                                        F.max_by("hash", "seq").alias("last_hash")))


@register("audit_last_hash", "2.1", f"""WITH {ENTRIES_CTE}
SELECT arg_max(hash, seq) AS last_hash, max(seq)::BIGINT AS last_seq FROM entries""")
def audit_last_hash(spark, sf_dir):
    return AU.last_hash(_entries(spark, sf_dir), [])


@register("audit_recent", "2.1", f"""WITH {ENTRIES_CTE}
SELECT seq, request_id, tier, status FROM entries ORDER BY seq DESC LIMIT 100""")
def audit_recent(spark, sf_dir):
    return AU.recent(_entries(spark, sf_dir), 100).select("seq", "request_id", "tier", "status")


@register("audit_total", "2.6", f"""WITH {ENTRIES_CTE}
SELECT count(*)::BIGINT AS total FROM entries""")
def audit_total(spark, sf_dir):
    return _entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


_KPI_SELECT = """SELECT count(*)::BIGINT AS calls,
       count(*) FILTER (WHERE tier = 'public')::BIGINT AS public,
       count(*) FILTER (WHERE tier = 'private')::BIGINT AS private,
       count(*) FILTER (WHERE tier = 'sealed')::BIGINT AS sealed,
       coalesce(sum(CASE WHEN kv % 3 > 0 THEN kv % 3 ELSE 0 END + CASE WHEN kv % 2 > 0 THEN kv % 2 ELSE 0 END), 0)::BIGINT AS entities"""


@register("kpi_by_day", "2.6", f"""WITH {ENTRIES_CTE}
SELECT substr(timestamp, 1, 10) AS day, {_KPI_SELECT[7:]} FROM entries GROUP BY 1""")
def kpi_by_day(spark, sf_dir):
    return AU.kpi_by_day(_entries(spark, sf_dir))


@register("kpi_today", "2.6", f"""WITH {ENTRIES_CTE},
k AS ({_KPI_SELECT} FROM entries WHERE starts_with(timestamp, '{AS_OF_DAY}'))
SELECT '{AS_OF_DAY}' AS day, calls, public, private, sealed, entities,
       entities::VARCHAR || CASE WHEN entities = 1 THEN ' entity' ELSE ' entities' END || ' redacted today' AS entities_label
FROM k""")
def kpi_today(spark, sf_dir):
    """KPI tiles for one day over all entries (exact)."""
    return AU.kpi_today(_entries_of(spark, sf_dir, AS_OF_DAY), AS_OF_DAY)


@register("kpi_today_last100", "2.6", f"""WITH {ENTRIES_CTE},
r AS (SELECT * FROM entries ORDER BY seq DESC LIMIT 100),
k AS ({_KPI_SELECT} FROM r WHERE starts_with(timestamp, '{LAST_DAY}'))
SELECT '{LAST_DAY}' AS day, calls, public, private, sealed, entities,
       entities::VARCHAR || CASE WHEN entities = 1 THEN ' entity' ELSE ' entities' END || ' redacted today' AS entities_label
FROM k""")
def kpi_today_last100(spark, sf_dir):
    """Dashboard variant: only the newest 100 entries are looked at."""
    return AU.kpi_today(_entries(spark, sf_dir), LAST_DAY, limit=100)


@register("today_filter", "2.2", f"""WITH {ENTRIES_CTE}
SELECT seq, request_id, tier FROM entries WHERE starts_with(timestamp, '{AS_OF_DAY}')""")
def today_filter(spark, sf_dir):
    return AU.today_filter(_entries_of(spark, sf_dir, AS_OF_DAY), AS_OF_DAY).select("seq", "request_id", "tier")


@register("audit_row_view", "2.2", f"""WITH {ENTRIES_CTE}
SELECT seq, substr(replace(timestamp, 'T', ' '), 1, 19) AS time, tenant, tier, status,
       CASE WHEN status = 'ok' THEN 'status-ok' ELSE 'status-error' END AS status_class,
       coalesce(nullif(concat_ws(' ', CASE WHEN kv % 3 > 0 THEN 'email × ' || (kv % 3)::VARCHAR END,
                                      CASE WHEN kv % 2 > 0 THEN 'vendor × ' || (kv % 2)::VARCHAR END), ''), 'none') AS chips,
       duration_ms::VARCHAR || ' ms' AS duration, substr(hash, 1, 12) AS hash_short
FROM entries""")
def audit_row_view(spark, sf_dir):
    return AU.row_view(_entries(spark, sf_dir))


@register("call_status", "2.4", f"""WITH {ENTRIES_CTE}
SELECT status, tier, count(*)::BIGINT AS n, count(error)::BIGINT AS n_with_error FROM entries GROUP BY status, tier""")
def call_status(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.groupBy("status", "tier").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_with_error"))


@register("join_chain_self", "2.5", f"""WITH {ENTRIES_CTE}
SELECT seq, hash, prev_hash, prev_hash IS NOT DISTINCT FROM lag(hash) OVER (ORDER BY seq) AS link_ok FROM chained""")
def join_chain_self(spark, sf_dir):
    """Entry i joined to entry i-1 of one log by an equi self-join on
    seq = seq + 1 (hash-partitioned on seq: no single-task window)."""
    c = _chained(spark, sf_dir).select("seq", "hash", "prev_hash")
    prev = c.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_ph"))
    return c.join(prev, "seq", "left").select("seq", "hash", "prev_hash",
                                              F.col("prev_hash").eqNullSafe(F.col("_ph")).alias("link_ok"))
