"""Finance queries: treasury, payables and payments, funds, consolidation.

Each key has a Spark builder (operators over the domain views) and an
independently written DuckDB formulation of the same derivation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidation as CO
from ..operators import funds as FU
from ..operators import payables as PY
from ..operators import treasury as TR
from ..sources import domain as D
from .registry import register

AS_OF = D.AS_OF
FUNDS_AS_OF = D.FUNDS_AS_OF
PL_PERIOD = "1999-Q1"


def _ccy(k: str) -> str:
    return f"CASE {k} % 3 WHEN 0 THEN 'CHF' WHEN 1 THEN 'EUR' ELSE 'USD' END"


# ------------------------------------------------------------ oracle CTEs --

FX_CTE = f"""fx AS (
  SELECT ccy, date, ((9000 + c % 997) / 10000.0)::DECIMAL(18,8) AS rate_to_chf FROM (
    SELECT {_ccy('s.s_nationkey')} AS ccy, l.l_shipdate::DATE AS date, sum(round(l.l_discount * 100)::BIGINT) AS c
    FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2)
  WHERE ccy <> 'CHF' AND day(date) % 4 <> 0),
ra AS (
  SELECT ccy, arg_max(rate_to_chf, date) AS rate_to_chf FROM fx WHERE date <= DATE '{AS_OF}' GROUP BY ccy
  UNION ALL SELECT 'CHF' AS ccy, 1::DECIMAL(18,8) AS rate_to_chf)"""

TXN_CTE = FX_CTE + f""",
txn AS (
  SELECT l.l_shipdate::DATE AS booking_date, ne.n_name AS entity, r.r_name AS bank,
         {_ccy('s.s_nationkey')} AS currency,
         CASE WHEN l.l_suppkey % 37 = 0 THEN '' WHEN l.l_suppkey % 10 = 0 THEN lower(ns.n_name) ELSE s.s_name END
           AS counterparty,
         CASE WHEN l.l_returnflag = 'R' THEN 'in' ELSE 'out' END AS direction,
         round(l.l_extendedprice::DECIMAL(18,2) * (1 - l.l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2) AS amount
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
       JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation ne ON ne.n_nationkey = c.c_nationkey
       JOIN region r ON r.r_regionkey = ne.n_regionkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey),
conv AS (
  SELECT t.*, round(t.amount * CASE WHEN t.currency = 'CHF' THEN 1::DECIMAL(18,8) ELSE f.rate_to_chf END, 2)
         ::DECIMAL(18,2) AS amount_chf
  FROM txn t ASOF LEFT JOIN fx f ON f.ccy = t.currency AND t.booking_date >= f.date),
cls AS (
  SELECT *, lower(trim(counterparty)) IN (SELECT lower(trim(n_name)) FROM nation) AS is_internal FROM conv)"""

INV_CTE = FX_CTE + f""",
inv AS (
  SELECT 'INV-' || o.o_orderkey::VARCHAR AS invoice_number,
         'Vendor ' || (o.o_custkey % 300)::VARCHAR AS vendor,
         c.c_mktsegment AS entity, {_ccy('c.c_nationkey')} AS currency,
         o.o_totalprice::DECIMAL(18,2) AS amount,
         round(o.o_totalprice::DECIMAL(18,2) * 1.077::DECIMAL(4,3), 2)::DECIMAL(18,2) AS gross,
         'ACC' || o.o_custkey::VARCHAR AS debit_account,
         CASE WHEN o.o_orderstatus = 'F' THEN 'paid' ELSE 'open' END AS status,
         o.o_orderdate::DATE AS issue_date,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              ELSE o.o_orderdate::DATE + ((o.o_orderkey % 3 + 1) * 30)::INTEGER END AS due_date
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
invc AS (
  SELECT i.*, round(i.amount * ra.rate_to_chf, 2)::DECIMAL(18,2) AS amount_chf
  FROM inv i LEFT JOIN ra ON ra.ccy = i.currency WHERE i.issue_date <= DATE '{AS_OF}'),
opn AS (SELECT * FROM invc WHERE status = 'open'),
acc AS (
  SELECT 'ACC' || c_custkey::VARCHAR AS account_number, c_mktsegment AS owner, {_ccy('c_nationkey')} AS currency,
         c_acctbal::DECIMAL(18,2) AS balance_native FROM customer),
accc AS (
  SELECT a.*, round(a.balance_native * ra.rate_to_chf, 2)::DECIMAL(18,2) AS balance_chf, ra.rate_to_chf
  FROM acc a LEFT JOIN ra ON ra.ccy = a.currency),
paid AS (
  SELECT CASE WHEN o.o_orderkey % 17 = 0 THEN 'vendr' ELSE 'vendor' END || (o.o_custkey % 300)::VARCHAR AS vendor,
         c.c_mktsegment AS entity,
         CASE WHEN o.o_orderkey % 2 = 0 THEN 'INV-' || o.o_orderkey::VARCHAR || '.0'
              ELSE 'INV-' || o.o_orderkey::VARCHAR END AS invoice_number,
         {_ccy('c.c_nationkey')} AS currency,
         CASE WHEN o.o_orderstatus = 'F' OR o.o_orderkey % 4 = 0 THEN o.o_totalprice::DECIMAL(18,2)
              ELSE round(o.o_totalprice::DECIMAL(18,2) * 0.5::DECIMAL(2,1), 2)::DECIMAL(18,2) END AS amount,
         o.o_orderdate::DATE + 45 AS paid_date, 'ZV ' || o.o_orderkey::VARCHAR AS reference
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus IN ('F', 'P')
  UNION ALL
  SELECT s_name, 'HOUSEHOLD', '', {_ccy('s_nationkey')}, abs(s_acctbal)::DECIMAL(18,2), DATE '1999-06-25',
         '1999.06_' || replace(s_name, '#', '') FROM supplier),
paidk AS (
  SELECT *, CASE WHEN regexp_matches(reference, '^\\d{{4}}\\.\\d{{2}}_') AND coalesce(invoice_number, '') = ''
                 THEN 'payroll' ELSE 'vendor' END AS kind FROM paid),
pk AS (
  SELECT *, lower(regexp_replace(vendor, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS vk,
         regexp_replace(trim(invoice_number), '\\.0$', '') AS ik FROM paidk WHERE kind = 'vendor'),
ak AS (
  SELECT *, lower(regexp_replace(vendor, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS vk,
         regexp_replace(trim(invoice_number), '\\.0$', '') AS ik FROM inv),
recon AS (
  SELECT p.vendor, p.entity, p.invoice_number, p.currency, p.amount, p.paid_date,
         a.invoice_number AS ap_invoice_number, a.amount AS ap_amount,
         CASE WHEN a.invoice_number IS NULL THEN 'not_in_ap' WHEN p.amount = a.amount THEN 'matched'
              WHEN p.amount < a.amount THEN 'partial' ELSE 'overpaid' END AS status
  FROM pk p LEFT JOIN ak a ON a.vk = p.vk AND a.ik = p.ik AND a.currency = p.currency),
pend AS (
  SELECT 'PAY-' || o.o_orderkey::VARCHAR AS payment_id, c.c_name AS beneficiary,
         'ACC' || o.o_custkey::VARCHAR AS debit_account, c.c_mktsegment AS debit_entity,
         {_ccy('c.c_nationkey')} AS currency, o.o_orderdate::DATE AS execution_date,
         o.o_totalprice::DECIMAL(18,2) AS value,
         datediff('day', o.o_orderdate::DATE, DATE '{AS_OF}') AS days_in_auth,
         datediff('day', o.o_orderdate::DATE, DATE '{AS_OF}') >= 7 AS is_stuck
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderstatus = 'P' AND o.o_orderdate::DATE <= DATE '{AS_OF}'),
fc_out AS (
  SELECT debit_account AS account_number, due_date AS date, sum(gross)::DECIMAL(28,2) AS gross FROM opn
  WHERE due_date > DATE '{AS_OF}' AND due_date <= DATE '{AS_OF}' + 21 GROUP BY 1, 2),
grid AS (
  SELECT a.account_number, a.owner, a.currency, a.rate_to_chf, a.balance_chf AS now_chf, DATE '{AS_OF}' + d.k::INTEGER AS date
  FROM accc a CROSS JOIN (SELECT unnest(range(0, 22)) AS k) d),
flow AS (
  SELECT g.*, CASE WHEN g.rate_to_chf IS NULL THEN NULL
                   ELSE coalesce(round(-o.gross * g.rate_to_chf, 2), 0)::DECIMAL(18,2) END AS outflow_chf
  FROM grid g LEFT JOIN fc_out o ON o.account_number = g.account_number AND o.date = g.date),
fc AS (
  SELECT account_number, owner, currency, date, outflow_chf,
         (now_chf + sum(outflow_chf) OVER (PARTITION BY account_number ORDER BY date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DECIMAL(28,2) AS balance_chf
  FROM flow)"""


def _bucket_sql(due: str) -> str:
    d = f"datediff('day', {due}, DATE '{AS_OF}')"
    return (f"CASE WHEN {due} IS NULL THEN 'unknown' WHEN {d} <= 0 THEN 'current' WHEN {d} <= 30 THEN '0-30' "
            f"WHEN {d} <= 60 THEN '31-60' WHEN {d} <= 90 THEN '61-90' ELSE '90+' END")


def _s0(expr: str) -> str:
    return f"coalesce(sum({expr}), 0)::DECIMAL(28,2)"


def _fin(spark, sf_dir):
    rates = D.fx_rates(spark, sf_dir)
    return TR.fx_fill(rates), TR.rates_at(rates, AS_OF)


def _conv(spark, sf_dir):
    return TR.to_chf(D.bank_txns(spark, sf_dir), D.fx_rates(spark, sf_dir))


def _cls(spark, sf_dir):
    return TR.classify_intercompany(_conv(spark, sf_dir), D.group_entities(spark, sf_dir))


# ---------------------------------------------------------------- treasury --

@register("fx_fill", "2.5", f"""WITH {FX_CTE}
SELECT d.ccy, d.date, f.rate_to_chf
FROM (SELECT ccy, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM fx GROUP BY ccy) d
ASOF JOIN fx f ON f.ccy = d.ccy AND d.date >= f.date""")
def fx_fill(spark, sf_dir):
    return _fin(spark, sf_dir)[0]


@register("join_fx_asof", "2.5", f"""WITH {TXN_CTE}
SELECT booking_date, entity, currency, direction, amount, amount_chf FROM conv""")
def join_fx_asof(spark, sf_dir):
    return _conv(spark, sf_dir).select("booking_date", "entity", "currency", "direction", "amount", "amount_chf")


_IN, _OUT = "CASE WHEN direction = 'in' THEN {} END", "CASE WHEN direction = 'out' THEN {} END"


@register("flows_by_currency", "2.6", f"""WITH {TXN_CTE}
SELECT currency, {_s0(_IN.format('amount'))} AS in_native, {_s0(_OUT.format('amount'))} AS out_native,
       count(*) AS n_txns, {_s0(_IN.format('amount'))} - {_s0(_OUT.format('amount'))} AS net_native
FROM txn GROUP BY currency""")
def flows_by_currency(spark, sf_dir):
    return TR.flows_by_currency(D.bank_txns(spark, sf_dir))


@register("flows_by_entity", "2.6", f"""WITH {TXN_CTE},
g AS (SELECT entity, currency, {_s0(_IN.format('amount'))} AS in_native, {_s0(_OUT.format('amount'))} AS out_native,
             {_s0(_IN.format('amount_chf'))} AS in_chf, {_s0(_OUT.format('amount_chf'))} AS out_chf,
             count({_IN.format('1')}) AS n_in, count({_OUT.format('1')}) AS n_out
      FROM conv GROUP BY entity, currency),
u AS (SELECT *, 'currency' AS level FROM g
      UNION ALL SELECT entity, NULL, NULL, NULL, sum(in_chf)::DECIMAL(28,2), sum(out_chf)::DECIMAL(28,2),
                       sum(n_in), sum(n_out), 'entity' FROM g GROUP BY entity)
SELECT entity, currency, in_native, out_native, in_chf, out_chf, n_in, n_out, level,
       in_chf - out_chf AS net_chf, in_native - out_native AS net_native FROM u""")
def flows_by_entity(spark, sf_dir):
    return TR.flows_by_entity(_conv(spark, sf_dir))


@register("cashflow_monthly", "2.6", f"""WITH {TXN_CTE}
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS n_txns, {_s0(_IN.format('amount_chf'))} AS in_chf,
       {_s0(_OUT.format('amount_chf'))} AS out_chf, count(*) FILTER (WHERE amount_chf IS NULL) AS n_unconverted,
       {_s0(_IN.format('amount_chf'))} - {_s0(_OUT.format('amount_chf'))} AS net_chf
FROM conv GROUP BY 1""")
def cashflow_monthly(spark, sf_dir):
    return TR.cashflow_monthly(_conv(spark, sf_dir))


@register("intercompany_pairs", "2.6", f"""WITH {TXN_CTE}
SELECT CASE WHEN direction = 'out' THEN entity ELSE lower(trim(counterparty)) END AS payer,
       CASE WHEN direction = 'out' THEN lower(trim(counterparty)) ELSE entity END AS payee,
       {_s0('amount_chf')} AS amount_chf, count(*) AS n_txns
FROM cls WHERE is_internal GROUP BY 1, 2""")
def intercompany_pairs(spark, sf_dir):
    return TR.intercompany_pairs(_cls(spark, sf_dir))


@register("intercompany_vs_external", "2.6", f"""WITH {TXN_CTE}
SELECT CASE WHEN is_internal THEN 'internal' ELSE 'external' END AS class,
       {_s0(_IN.format('amount_chf'))} AS in_chf, count({_IN.format('1')}) AS n_in,
       {_s0(_OUT.format('amount_chf'))} AS out_chf, count({_OUT.format('1')}) AS n_out
FROM cls GROUP BY 1""")
def intercompany_vs_external(spark, sf_dir):
    return TR.intercompany_vs_external(_cls(spark, sf_dir))


_TOP_CP_SQL = f"""SELECT lower(trim(counterparty)) AS counterparty, {_s0('amount_chf')} AS out_chf, count(*) AS n_txns
FROM cls WHERE NOT is_internal AND direction = 'out' AND lower(trim(counterparty)) <> ''
GROUP BY 1 ORDER BY out_chf DESC, counterparty ASC LIMIT {{k}}"""


@register("top_counterparties", "2.6", f"""WITH {TXN_CTE}
{_TOP_CP_SQL.format(k=10)}""")
def top_counterparties(spark, sf_dir):
    return TR.top_counterparties(_cls(spark, sf_dir), 10)


_ACCT_SQL = "upper(entity) || '-' || upper(bank) || '-' || currency"


@register("by_bank", "2.6", f"""WITH {TXN_CTE},
f AS (SELECT bank, count(DISTINCT {_ACCT_SQL}) AS n_accounts, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies,
             min(booking_date) AS first_date, max(booking_date) AS last_date,
             {_s0(_IN.format('amount_chf'))} AS in_chf, {_s0(_OUT.format('amount_chf'))} AS out_chf, count(*) AS n_txns
      FROM conv GROUP BY bank),
b AS (SELECT r_name AS bank FROM region UNION ALL SELECT 'CUSTODY')
SELECT b.bank, coalesce(n_accounts, 0) AS n_accounts, coalesce(currencies, '') AS currencies, first_date, last_date,
       coalesce(in_chf, 0)::DECIMAL(28,2) AS in_chf, coalesce(out_chf, 0)::DECIMAL(28,2) AS out_chf,
       (coalesce(in_chf, 0) - coalesce(out_chf, 0))::DECIMAL(28,2) AS net_chf, coalesce(n_txns, 0) AS n_txns,
       CASE WHEN n_txns IS NULL THEN 'no_data' ELSE 'ok' END AS status
FROM b LEFT JOIN f ON f.bank = b.bank""")
def by_bank(spark, sf_dir):
    return TR.by_bank(D.banks(spark, sf_dir), _conv(spark, sf_dir))


@register("by_company", "2.6", f"""WITH {TXN_CTE},
a AS (SELECT entity, bank, currency, {_ACCT_SQL} AS account, {_s0(_IN.format('amount_chf'))} AS in_chf,
             {_s0(_OUT.format('amount_chf'))} AS out_chf, count(*) AS n_txns FROM conv GROUP BY entity, bank, currency)
SELECT entity, count(*) AS account_count,
       '[' || string_agg('{{"account":"' || account || '","bank":"' || bank || '","currency":"' || currency || '","in_chf":' || in_chf::VARCHAR
              || ',"out_chf":' || out_chf::VARCHAR || ',"n_txns":' || n_txns::VARCHAR || '}}', ',' ORDER BY account) || ']' AS accounts,
       sum(in_chf)::DECIMAL(28,2) AS in_chf, sum(out_chf)::DECIMAL(28,2) AS out_chf, sum(n_txns)::BIGINT AS n_txns,
       sum(in_chf)::DECIMAL(28,2) - sum(out_chf)::DECIMAL(28,2) AS net_chf
FROM a GROUP BY entity""")
def by_company(spark, sf_dir):
    """Companies with their accounts; the nested records as JSON, so that they can be compared as text."""
    return TR.by_company(_conv(spark, sf_dir)).withColumn("accounts", F.to_json("accounts"))


@register("treasury_summary", "2.6", f"""WITH {TXN_CTE},
tc AS ({_TOP_CP_SQL.format(k=1)}),
te AS (SELECT entity, {_s0('amount_chf')} AS o FROM cls WHERE direction = 'out' GROUP BY entity)
SELECT count(DISTINCT {_ACCT_SQL}) AS n_accounts, min(booking_date) AS first_date, max(booking_date) AS last_date,
       {_s0(_IN.format('amount_chf'))} AS in_chf, {_s0(_OUT.format('amount_chf'))} AS out_chf, count(*) AS n_txns,
       count(*) FILTER (WHERE amount_chf IS NULL) AS n_unconverted, (SELECT counterparty FROM tc) AS top_counterparty,
       (SELECT entity FROM te ORDER BY o DESC, entity DESC LIMIT 1) AS top_entity_by_out,
       {_s0(_IN.format('amount_chf'))} - {_s0(_OUT.format('amount_chf'))} AS net_chf
FROM cls""")
def treasury_summary(spark, sf_dir):
    return TR.treasury_summary(_cls(spark, sf_dir))


_ACCOUNTS_SQL = f"""sa AS (SELECT entity, bank, currency, count(*) AS txn_count, {_ACCT_SQL} AS account, 'statement' AS source
       FROM txn GROUP BY entity, bank, currency),
ia AS (SELECT DISTINCT n.n_name AS entity, 'CUSTODY' AS bank, {_ccy('s.s_nationkey')} AS currency,
              NULL::BIGINT AS txn_count, upper(n.n_name) || '-CUSTODY-' || {_ccy('s.s_nationkey')} AS account,
              'inventory' AS source
       FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),
au AS (SELECT * FROM sa UNION ALL SELECT * FROM ia)"""


def _accounts_union(spark, sf_dir):
    return TR.accounts_union(TR.statement_accounts(D.bank_txns(spark, sf_dir)), D.inventory_accounts(spark, sf_dir))


@register("accounts_union", "2.9", f"""WITH {TXN_CTE}, {_ACCOUNTS_SQL}
SELECT entity, bank, currency, txn_count, account, source FROM au""")
def accounts_union(spark, sf_dir):
    return _accounts_union(spark, sf_dir).select("entity", "bank", "currency", "txn_count", "account", "source")


@register("join_account_flows", "2.5", f"""WITH {TXN_CTE}, {_ACCOUNTS_SQL},
f AS (SELECT {_ACCT_SQL} AS account, {_s0(_IN.format('amount_chf'))} AS in_chf, {_s0(_OUT.format('amount_chf'))} AS out_chf,
             count(*) AS n_txns FROM conv GROUP BY 1)
SELECT au.account, entity, bank, currency, source, f.n_txns IS NOT NULL AS has_flow_data,
       coalesce(in_chf, 0)::DECIMAL(28,2) AS in_chf, coalesce(out_chf, 0)::DECIMAL(28,2) AS out_chf,
       coalesce(f.n_txns, 0) AS n_txns
FROM au LEFT JOIN f ON f.account = au.account""")
def join_account_flows(spark, sf_dir):
    return TR.account_flows(_accounts_union(spark, sf_dir), _conv(spark, sf_dir))


# ---------------------------------------------------------------- payables --

def _inv(spark, sf_dir):
    return D.invoices(spark, sf_dir), _fin(spark, sf_dir)[1]


@register("ap_aging", "2.6", f"""WITH {INV_CTE},
g AS (SELECT {_bucket_sql('due_date')} AS bucket, count(*) AS n, {_s0('amount_chf')} AS s FROM opn GROUP BY 1),
b AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(PY.AGING_BUCKETS))}) t(bucket_no, bucket))
SELECT b.bucket_no, b.bucket, coalesce(g.n, 0) AS n_invoices, coalesce(g.s, 0)::DECIMAL(28,2) AS amount_chf
FROM b LEFT JOIN g ON g.bucket = b.bucket""")
def ap_aging(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.ap_aging(inv, r, AS_OF)


_VENDOR_SQL = f"""SELECT vendor, count(*) AS n_invoices, {_s0('amount_chf')} AS total_chf,
       count(CASE WHEN status = 'open' THEN 1 END) AS open_count,
       {_s0("CASE WHEN status = 'open' THEN amount_chf END")} AS open_chf
FROM invc GROUP BY vendor"""
_ENTITY_SQL = f"""SELECT entity, count(CASE WHEN status = 'open' THEN 1 END) AS open_count,
       {_s0("CASE WHEN status = 'open' THEN amount_chf END")} AS open_chf,
       count(CASE WHEN status = 'open' AND due_date < DATE '{AS_OF}' THEN 1 END) AS overdue_count,
       {_s0(f"CASE WHEN status = 'open' AND due_date < DATE '{AS_OF}' THEN amount_chf END")} AS overdue_chf,
       count(CASE WHEN status = 'paid' THEN 1 END) AS paid_count,
       {_s0("CASE WHEN status = 'paid' THEN amount_chf END")} AS paid_chf
FROM invc GROUP BY entity"""


@register("ap_by_vendor", "2.6", f"""WITH {INV_CTE}
{_VENDOR_SQL}""")
def ap_by_vendor(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.ap_by_vendor(inv, r, AS_OF)


@register("ap_by_entity", "2.6", f"""WITH {INV_CTE}
{_ENTITY_SQL}""")
def ap_by_entity(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.ap_by_entity(inv, r, AS_OF)


@register("ap_summary", "2.6", f"""WITH {INV_CTE}, e AS ({_ENTITY_SQL}), v AS ({_VENDOR_SQL})
SELECT sum(open_count) AS open_count, sum(open_chf)::DECIMAL(28,2) AS open_chf, sum(overdue_count) AS overdue_count,
       sum(overdue_chf)::DECIMAL(28,2) AS overdue_chf,
       (SELECT entity FROM e ORDER BY open_chf DESC, entity DESC LIMIT 1) AS top_open_entity,
       string_agg(entity, ',' ORDER BY entity) AS entities,
       (SELECT vendor FROM v ORDER BY total_chf DESC, vendor DESC LIMIT 1) AS top_vendor
FROM e""")
def ap_summary(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.ap_summary(inv, r, AS_OF)


_OPEN_TOTAL_SQL = f"""SELECT count(*) AS open_count, {_s0("CASE WHEN currency = 'CHF' THEN amount END")} AS total_chf_only,
       {_s0('amount_chf')} AS total_converted_chf FROM opn"""


@register("open_invoice_total", "2.6", f"""WITH {INV_CTE}
{_OPEN_TOTAL_SQL}""")
def open_invoice_total(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.open_invoice_total(inv, r, AS_OF)


@register("pending_payments", "2.6", f"""WITH {INV_CTE}
SELECT * FROM pend""")
def pending_payments(spark, sf_dir):
    return PY.pending_payments(D.pending_payments(spark, sf_dir, AS_OF), AS_OF)


@register("payment_kind", "2.6", f"""WITH {INV_CTE}
SELECT vendor, entity, invoice_number, currency, amount, paid_date, reference, kind FROM paidk""")
def payment_kind(spark, sf_dir):
    return PY.payment_kind(D.paid_items(spark, sf_dir))


@register("join_recon_match", "2.5", f"""WITH {INV_CTE}
SELECT * FROM recon""")
def join_recon_match(spark, sf_dir):
    return PY.reconcile(D.paid_items(spark, sf_dir), D.invoices(spark, sf_dir))


@register("join_recon_anti", "2.5", f"""WITH {INV_CTE}
SELECT p.vendor, p.entity, p.invoice_number, p.currency, p.amount, p.paid_date
FROM pk p WHERE NOT EXISTS (SELECT 1 FROM ak a WHERE a.vk = p.vk AND a.ik = p.ik AND a.currency = p.currency)""")
def join_recon_anti(spark, sf_dir):
    return PY.recon_anti(D.paid_items(spark, sf_dir), D.invoices(spark, sf_dir))


@register("join_recon_semi", "2.5", f"""WITH {INV_CTE}
SELECT a.invoice_number, a.vendor, a.entity, a.currency, a.amount, a.due_date
FROM ak a WHERE a.status = 'open' AND a.issue_date <= DATE '{AS_OF}'
  AND EXISTS (SELECT 1 FROM pk p WHERE a.vk = p.vk AND a.ik = p.ik AND a.currency = p.currency)""")
def join_recon_semi(spark, sf_dir):
    return PY.recon_semi(D.invoices(spark, sf_dir), D.paid_items(spark, sf_dir), AS_OF)


_CASH_SQL = """SELECT CASE WHEN grouping(currency) = 0 THEN 'currency' WHEN grouping(owner) = 0 THEN 'owner' ELSE 'total' END
         AS level, currency, owner, count(*) AS n_accounts,
       CASE WHEN grouping(currency) = 0 THEN sum(balance_native)::DECIMAL(28,2) END AS balance_native,
       sum(balance_chf)::DECIMAL(28,2) AS balance_chf
FROM accc GROUP BY GROUPING SETS ((currency), (owner), ())"""


@register("cash_position", "2.6", f"""WITH {INV_CTE}
{_CASH_SQL}""")
def cash_position(spark, sf_dir):
    return PY.cash_position(D.cash_accounts(spark, sf_dir), _fin(spark, sf_dir)[1])


def _forecast(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    return PY.cash_forecast(D.cash_accounts(spark, sf_dir), inv, r, AS_OF)


@register("cash_forecast", "2.7", f"""WITH {INV_CTE}
SELECT * FROM fc""")
def cash_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir)


@register("cash_forecast_totals", "2.7", f"""WITH {INV_CTE}
SELECT date, count(*) AS n_accounts, {_s0('outflow_chf')} AS outflow_chf, {_s0('balance_chf')} AS balance_chf FROM fc GROUP BY date""")
def cash_forecast_totals(spark, sf_dir):
    """Outflow and balance of the whole group per forecast date."""
    return PY.forecast_totals(_forecast(spark, sf_dir))


@register("shortfall_flag", "2.7", f"""WITH {INV_CTE}
SELECT account_number, min(date) AS first_negative, min(balance_chf) AS lowest_balance_chf
FROM fc WHERE balance_chf < 0 GROUP BY account_number""")
def shortfall_flag(spark, sf_dir):
    return PY.shortfall_flag(_forecast(spark, sf_dir))


@register("payments_summary", "2.6", f"""WITH {INV_CTE},
c AS ({_CASH_SQL}), o AS ({_OPEN_TOTAL_SQL})
SELECT (SELECT balance_chf FROM c WHERE level = 'total') AS cash_chf,
       (SELECT {_s0('outflow_chf')} FROM fc) AS forecast_outflow_chf,
       (SELECT count(DISTINCT account_number) FROM fc) AS forecast_accounts,
       o.open_count, o.total_chf_only, o.total_converted_chf,
       (SELECT count(*) FROM pend) AS n_pending, (SELECT count(CASE WHEN is_stuck THEN 1 END) FROM pend) AS n_stuck,
       (SELECT {_s0('round(p.value * ra.rate_to_chf, 2)::DECIMAL(18,2)')} FROM pend p LEFT JOIN ra ON ra.ccy = p.currency)
         AS pending_chf,
       (SELECT count(CASE WHEN status = 'matched' THEN 1 END) FROM recon) AS recon_matched,
       (SELECT count(CASE WHEN status = 'not_in_ap' THEN 1 END) FROM recon) AS recon_not_in_ap
FROM o""")
def payments_summary(spark, sf_dir):
    inv, r = _inv(spark, sf_dir)
    acc = D.cash_accounts(spark, sf_dir)
    pend = PY.pending_summary(PY.pending_payments(D.pending_payments(spark, sf_dir, AS_OF), AS_OF), r)
    return PY.payments_summary(PY.cash_position(acc, r), PY.cash_forecast(acc, inv, r, AS_OF),
                               PY.open_invoice_total(inv, r, AS_OF), pend,
                               PY.reconcile(D.paid_items(spark, sf_dir), inv)).select(
        "cash_chf", "forecast_outflow_chf", "forecast_accounts", "open_count", "total_chf_only",
        "total_converted_chf", "n_pending", "n_stuck", "pending_chf", "recon_matched", "recon_not_in_ap")


# ------------------------------------------------------------------- funds --

def _list(vals) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


def _case_map(d: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v!r}" for k, v in d.items()) + " END"


FUND_CTE = f"""fd AS (SELECT event_type AS sp, ts::DATE AS date, sum(value::DECIMAL(18,2))::DECIMAL(28,2) AS flow,
              count(*) AS n FROM events GROUP BY 1, 2),
ser0 AS (SELECT sp, date, flow, n, ({FU.BASE_AUM} + sum(flow) OVER (PARTITION BY sp ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DECIMAL(28,2) AS aum FROM fd),
ser AS (SELECT *, flow::DOUBLE / coalesce(lag(aum) OVER (PARTITION BY sp ORDER BY date), {FU.BASE_AUM})::DOUBLE AS ret
        FROM ser0),
apr AS (SELECT sp, date,
          round(avg(ret) OVER (PARTITION BY sp ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) * 365, 6)
            AS apr_7d,
          round(avg(ret) OVER (PARTITION BY sp ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) * 365, 6)
            AS apr_30d,
          round(avg(ret) OVER (PARTITION BY sp, year(date) ORDER BY date
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 365, 6) AS apr_ytd
        FROM ser),
la AS (SELECT sp, arg_max(aum, date) AS aum, max(date) AS date FROM ser GROUP BY sp),
lapr AS (SELECT sp, arg_max(apr_7d, date) AS apr_7d, arg_max(apr_30d, date) AS apr_30d,
                arg_max(apr_ytd, date) AS apr_ytd FROM apr GROUP BY sp),
pos0 AS (SELECT event_type AS sp, {_list(FU.ASSET_CLASSES)}[user_id % 10 + 1] AS asset_class,
                {_list(FU.RISK_LEVELS)}[user_id % 4 + 1] AS risk, sum(value::DECIMAL(18,2))::DECIMAL(28,2) AS pos_value
         FROM events GROUP BY 1, 2, 3),
pos AS (SELECT *, pos_value::DOUBLE / (sum(pos_value) OVER (PARTITION BY sp))::DOUBLE AS share FROM pos0),
tv AS (SELECT la.sp, la.aum::DOUBLE AS tvl, lapr.apr_7d, lapr.apr_30d, {_case_map(FU.VAULT_CUT, 'la.sp')} AS cut
       FROM la JOIN lapr ON lapr.sp = la.sp)"""


def _fund(spark, sf_dir):
    s = FU.aum_series(FU.fund_daily(D.fund_flows(spark, sf_dir)))
    return s, FU.trailing_apr(s)


@register("aum_group", "2.6", f"""WITH {FUND_CTE}
SELECT sp, date, aum, round(aum::DOUBLE * 100 / (SELECT sum(aum) FROM la)::DOUBLE, 2) AS share_pct FROM la""")
def aum_group(spark, sf_dir):
    return FU.aum_group(_fund(spark, sf_dir)[0])


@register("position_rollup", "2.6", f"""WITH {FUND_CTE},
pv0 AS (SELECT event_type AS sp, {_list(FU.ASSET_CLASSES)}[user_id % 10 + 1] AS asset_class,
               {_list(FU.RISK_LEVELS)}[user_id % 4 + 1] AS risk, {_list(FU.VENUES)}[user_id % 3 + 1] AS venue,
               sum(value::DECIMAL(18,2))::DECIMAL(28,2) AS pos_value FROM events GROUP BY 1, 2, 3, 4),
v AS (SELECT pv0.*, round(pos_value::DOUBLE / (sum(pos_value) OVER (PARTITION BY sp))::DOUBLE * la.aum::DOUBLE, 2)::DECIMAL(28,2) AS value_usd
      FROM pv0 JOIN la USING (sp))
SELECT sp, asset_class, risk, venue, sum(value_usd)::DECIMAL(28,2) AS value_usd, count(*) AS n_positions,
       grouping_id(sp, asset_class, risk, venue) AS level
FROM v GROUP BY ROLLUP (sp, asset_class, risk, venue)""")
def position_rollup(spark, sf_dir):
    return FU.position_rollup(FU.positions(D.fund_flows(spark, sf_dir), by_venue=True), _fund(spark, sf_dir)[0])


@register("exposure_wide", "2.6", f"""WITH {FUND_CTE}
SELECT sp, {', '.join(f"coalesce(round(sum(CASE WHEN asset_class = '{c}' THEN share END), 6), 0.0) AS {c}"
                      for c in FU.ASSET_CLASSES)}
FROM pos GROUP BY sp""")
def exposure_wide(spark, sf_dir):
    return FU.exposure_wide(FU.positions(D.fund_flows(spark, sf_dir)))


def _fin_sql() -> str:
    t = FU.FEE_TERMS
    f = f"({t['days']} / 365.0)"
    return f"""ff0 AS (SELECT la.sp, la.aum::DOUBLE AS a, lapr.apr_30d FROM la JOIN lapr ON lapr.sp = la.sp),
ff1 AS (SELECT sp, round(a, 2) AS aum, round(a * apr_30d * {f}, 2) AS gross_income, round(a * {t['mgmt_fee']} * {f}, 2) AS mgmt_fee,
               round(a * {t['admin_fee']} * {f}, 2) AS admin_expense, round(a * {t['cash_share']}, 2) AS cash,
               round(a * (1 - {t['cash_share']}), 2) AS investments, a FROM ff0),
ff2 AS (SELECT *, round(greatest(gross_income, 0.0) * {t['perf_fee']}, 2) AS perf_fee,
               round(a * {t['admin_accrual']} - admin_expense, 2) AS accrued_admin FROM ff1),
ff3 AS (SELECT sp, aum, gross_income, mgmt_fee, perf_fee, admin_expense, cash, investments, accrued_admin,
               round(gross_income - mgmt_fee - perf_fee - admin_expense, 2) AS net_income,
               round(cash + investments, 2) AS total_assets FROM ff2),
ff AS (SELECT *, round(total_assets - accrued_admin, 2) AS net_assets FROM ff3)"""


_FF_COLS = ("aum", "gross_income", "mgmt_fee", "perf_fee", "admin_expense", "cash", "investments", "accrued_admin",
            "net_income", "total_assets", "net_assets")


@register("fund_financials", "2.6", f"""WITH {FUND_CTE}, {_fin_sql()}
SELECT * FROM ff UNION ALL SELECT 'GROUP', {', '.join(f'round(sum({c}), 2)' for c in _FF_COLS)} FROM ff""")
def fund_financials(spark, sf_dir):
    s, a = _fund(spark, sf_dir)
    return FU.fund_financials(s, a)


@register("capacity_util", "2.6", f"""WITH {FUND_CTE}
SELECT sp, arg_max(aum, date) AS current, round(max(aum)::DOUBLE * {FU.CAPACITY_MULT}, 2) AS capacity,
       round(arg_max(aum, date)::DOUBLE * 100 / (max(aum)::DOUBLE * {FU.CAPACITY_MULT}), 1) AS utilization_pct
FROM ser GROUP BY sp""")
def capacity_util(spark, sf_dir):
    return FU.capacity_util(_fund(spark, sf_dir)[0])


@register("week_dynamics", "2.6", f"""WITH {FUND_CTE},
w AS (SELECT sp, tvl, round(tvl * apr_7d / 52, 2) AS yield_usd, cut FROM tv),
w2 AS (SELECT *, round(yield_usd * cut, 2) AS fees_usd FROM w)
SELECT sp, round(tvl, 2) AS tvl, yield_usd, cut, fees_usd FROM w2
UNION ALL SELECT 'TOTAL', round(sum(tvl), 2), round(sum(yield_usd), 2),
                 round(round(sum(fees_usd), 2) / round(sum(yield_usd), 2), 4), round(sum(fees_usd), 2) FROM w2""")
def week_dynamics(spark, sf_dir):
    s, a = _fund(spark, sf_dir)
    return FU.week_dynamics(s, a)


@register("overview_30d", "2.6", f"""WITH {FUND_CTE}
SELECT round(sum(tvl), 2) AS total_tvl, round(sum(tvl * apr_30d / 12), 2) AS yield_30d,
       round(sum(tvl * apr_30d / 12 * cut), 2) AS fees_30d FROM tv""")
def overview_30d(spark, sf_dir):
    s, a = _fund(spark, sf_dir)
    return FU.overview_30d(s, a)


_PEER_SQL = f"""win AS (SELECT * FROM events WHERE ts::DATE > DATE '{FUNDS_AS_OF}' - 7 AND ts::DATE <= DATE '{FUNDS_AS_OF}'),
pe AS (SELECT CASE user_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'eth' ELSE 'btc' END AS peer_class, user_id,
              sum(round(value * 100)::BIGINT) // (count(*) * 10) AS apy_bp FROM win GROUP BY 1, 2),
h AS (SELECT peer_class, apy_bp, count(*) AS c FROM pe GROUP BY 1, 2),
h2 AS (SELECT *, sum(c) OVER (PARTITION BY peer_class ORDER BY apy_bp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              sum(c) OVER (PARTITION BY peer_class) AS n FROM h),
q AS (SELECT peer_class, min(CASE WHEN cum >= ceil(n * 0.5) THEN apy_bp END) AS median_bp,
             min(CASE WHEN cum >= ceil(n * 0.9) THEN apy_bp END) AS p90_bp FROM h2 GROUP BY 1),
va AS (SELECT event_type AS sp, sum(round(value * 100)::BIGINT) // (count(*) * 10) AS apy_bp FROM win GROUP BY 1),
vr AS (SELECT va.sp, {_case_map(FU.VAULT_PEER_CLASS, 'va.sp')} AS peer_class, va.apy_bp FROM va),
pr AS (SELECT vr.sp, vr.peer_class, vr.apy_bp, q.median_bp, q.p90_bp,
              (CASE WHEN vr.apy_bp <= q.median_bp THEN round(50.0 * vr.apy_bp / q.median_bp)
                    WHEN vr.apy_bp <= q.p90_bp THEN round(50.0 + 40.0 * (vr.apy_bp - q.median_bp) / (q.p90_bp - q.median_bp))
                    ELSE 99.0 END)::INTEGER AS rank_percentile
       FROM vr LEFT JOIN q ON q.peer_class = vr.peer_class)"""


def _peer_rank(spark, sf_dir):
    flows = D.fund_flows(spark, sf_dir)
    q = FU.peer_quantiles(FU.apy_bp(D.peer_vaults(spark, sf_dir), ["peer_class", "user_id"], FUNDS_AS_OF))
    return FU.peer_rank(FU.apy_bp(flows, ["sp"], FUNDS_AS_OF), q)


@register("peer_rank", "2.6", f"""WITH {_PEER_SQL}
SELECT sp, peer_class, apy_bp, median_bp, p90_bp, rank_percentile FROM pr""")
def peer_rank(spark, sf_dir):
    return _peer_rank(spark, sf_dir)


@register("join_peer", "2.5", f"""WITH {_PEER_SQL}
SELECT sp, peer_class, median_bp, p90_bp FROM pr""")
def join_peer(spark, sf_dir):
    return _peer_rank(spark, sf_dir).select("sp", "peer_class", "median_bp", "p90_bp")


@register("join_fund", "2.5", f"""WITH {FUND_CTE},
meta AS (SELECT sp, min(date) AS inception, count(*) AS n_days FROM ser GROUP BY sp)
SELECT la.sp, meta.inception, meta.n_days, la.aum, round(la.aum::DOUBLE / {FU.BASE_AUM}, 8) AS nav_per_unit,
       lapr.apr_7d, lapr.apr_30d, lapr.apr_ytd
FROM la JOIN meta ON meta.sp = la.sp JOIN lapr ON lapr.sp = la.sp""")
def join_fund(spark, sf_dir):
    s, a = _fund(spark, sf_dir)
    meta = s.groupBy("sp").agg(F.min("date").alias("inception"), F.count(F.lit(1)).alias("n_days"))
    la = FU.latest(s, ["aum"]).select("sp", "aum")
    lapr = FU.latest(a, ["apr_7d", "apr_30d", "apr_ytd"]).drop("date")
    return (la.join(meta, "sp").join(lapr, "sp")
            .select("sp", "inception", "n_days", "aum",
                    F.round(F.col("aum").cast("double") / FU.BASE_AUM, 8).alias("nav_per_unit"),
                    "apr_7d", "apr_30d", "apr_ytd"))


@register("trailing_apr", "2.7", f"""WITH {FUND_CTE}
SELECT sp, date, apr_7d, apr_30d, apr_ytd FROM apr""")
def trailing_apr(spark, sf_dir):
    return _fund(spark, sf_dir)[1]


@register("aum_history", "2.7", f"""WITH {FUND_CTE},
p AS (SELECT s.sp, floor(datediff('day', f.d0, s.date) / 3)::INTEGER AS point_no, arg_max(s.aum, s.date) AS aum_usd,
             max(s.date) AS date
      FROM ser s JOIN (SELECT sp, min(date) AS d0 FROM ser GROUP BY sp) f ON f.sp = s.sp GROUP BY 1, 2)
SELECT sp, point_no, strftime(date, '%Y-%m') AS month, aum_usd,
       aum_usd - lag(aum_usd) OVER (PARTITION BY sp ORDER BY point_no) AS change_usd FROM p""")
def aum_history(spark, sf_dir):
    return FU.aum_history(_fund(spark, sf_dir)[0], 3)


@register("tvl_series", "2.7", f"""WITH {FUND_CTE},
t AS (SELECT date, sum(aum)::DECIMAL(28,2) AS tvl FROM ser GROUP BY date)
SELECT date, tvl, round((SELECT avg(t2.tvl::DOUBLE) FROM t t2 WHERE t2.date BETWEEN t.date - 6 AND t.date), 2) AS ma7
FROM t""")
def tvl_series(spark, sf_dir):
    return FU.tvl_series(_fund(spark, sf_dir)[0])


NAV_CTE = """np AS (SELECT o_orderpriority AS fund, last_day(o_orderdate::DATE) AS period, count(*) AS n_files,
              count(DISTINCT o_custkey) AS investor_statement_count FROM orders GROUP BY 1, 2),
nav AS (SELECT fund || ':' || strftime(period, '%Y-%m') AS package_id, fund, period, investor_statement_count,
               n_files + investor_statement_count AS file_count FROM np)"""


@register("nav_packages", "2.6", f"""WITH {NAV_CTE}
SELECT fund, max(period) AS latest_period, count(*) AS package_count, arg_max(package_id, period) AS latest_package_id,
       arg_max(file_count, period) AS latest_file_count FROM nav GROUP BY fund""")
def nav_packages(spark, sf_dir):
    return FU.nav_packages(D.nav_package_rows(spark, sf_dir))


@register("latest_version", "2.7", f"""WITH {NAV_CTE}
SELECT fund, arg_max(package_id, period) AS package_id, max(period) AS period FROM nav GROUP BY fund""")
def latest_version(spark, sf_dir):
    p = D.nav_package_rows(spark, sf_dir)
    return p.groupBy("fund").agg(F.max_by("package_id", "period").alias("package_id"), F.max("period").alias("period"))


# ----------------------------------------------------------- consolidation --

CONS_CTE = """pl AS (
  SELECT r.r_name AS entity, year(l.l_shipdate)::VARCHAR || '-Q' || quarter(l.l_shipdate)::VARCHAR AS period,
         sum(round(l.l_extendedprice::DECIMAL(18,2) * (1 - l.l_discount::DECIMAL(4,2)), 2)) AS revenues,
         -sum(round(l.l_extendedprice::DECIMAL(18,2) * 0.6::DECIMAL(2,1), 2)) AS cost_of_goods,
         -sum(round(l.l_extendedprice::DECIMAL(18,2) * l.l_tax::DECIMAL(4,2), 2)) AS opex
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
       JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2),
pll AS (SELECT entity, period, 'revenues' AS line, revenues::DECIMAL(28,2) AS amount FROM pl
        UNION ALL SELECT entity, period, 'cost_of_goods', cost_of_goods::DECIMAL(28,2) FROM pl
        UNION ALL SELECT entity, period, 'opex', opex::DECIMAL(28,2) FROM pl),
lines AS (SELECT * FROM pll UNION ALL SELECT entity, period, 'ebitda', sum(amount)::DECIMAL(28,2) FROM pll GROUP BY 1, 2),
plc AS (SELECT period, line, entity, amount FROM lines
        UNION ALL SELECT period, line, 'CONSOLIDATED', sum(amount)::DECIMAL(28,2) FROM lines GROUP BY 1, 2),
creg AS (SELECT c.c_acctbal::DECIMAL(18,2) AS b, r.r_name AS entity FROM customer c
         JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
sreg AS (SELECT s.s_acctbal::DECIMAL(18,2) AS b, r.r_name AS entity FROM supplier s
         JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
bsl AS (SELECT entity, 'assets' AS line, sum(CASE WHEN b > 0 THEN b ELSE 0 END)::DECIMAL(28,2) AS amount FROM creg GROUP BY 1
        UNION ALL SELECT entity, 'liabilities', (-sum(CASE WHEN b < 0 THEN b ELSE 0 END))::DECIMAL(28,2) FROM creg GROUP BY 1
        UNION ALL SELECT entity, 'equity', sum(b)::DECIMAL(28,2) FROM sreg GROUP BY 1
        UNION ALL SELECT 'ADJUSTMENT', x.line, (SELECT (-sum(s_acctbal::DECIMAL(18,2)))::DECIMAL(28,2) FROM supplier
                                                WHERE s_acctbal::DECIMAL(18,2) > 9000)
                  FROM (VALUES ('assets'), ('equity')) x(line)),
bsc AS (SELECT line, entity, amount FROM bsl
        UNION ALL SELECT line, 'CONSOLIDATED', sum(amount)::DECIMAL(28,2) FROM bsl GROUP BY line)"""


def _pl(spark, sf_dir):
    return CO.pl_consolidation(D.pl_lines(spark, sf_dir))


def _bs(spark, sf_dir):
    return CO.bs_consolidation(D.bs_lines(spark, sf_dir))


@register("pl_consolidation", "2.6", f"""WITH {CONS_CTE}
SELECT * FROM plc""")
def pl_consolidation(spark, sf_dir):
    return _pl(spark, sf_dir)


@register("bs_consolidation", "2.6", f"""WITH {CONS_CTE}
SELECT * FROM bsc""")
def bs_consolidation(spark, sf_dir):
    return _bs(spark, sf_dir)


@register("bs_balance_check", "2.6", f"""WITH {CONS_CTE},
p AS (SELECT entity, coalesce(sum(CASE WHEN line = 'assets' THEN amount END), 0) AS assets,
             coalesce(sum(CASE WHEN line = 'liabilities' THEN amount END), 0) AS liabilities,
             coalesce(sum(CASE WHEN line = 'equity' THEN amount END), 0) AS equity FROM bsc GROUP BY entity)
SELECT entity, assets::DECIMAL(28,2) AS assets, liabilities::DECIMAL(28,2) AS liabilities, equity::DECIMAL(28,2) AS equity,
       (assets - liabilities - equity)::DECIMAL(28,2) AS gap, abs(assets - liabilities - equity) <= 0.01 AS ok FROM p""")
def bs_balance_check(spark, sf_dir):
    return CO.bs_balance_check(_bs(spark, sf_dir))


@register("pl_history_rollup", "2.6", f"""WITH {CONS_CTE}
SELECT regexp_extract(period, '^(\\d{{4}})', 1) AS year, line, sum(amount)::DECIMAL(28,2) AS amount,
       count(DISTINCT period) AS n_quarters FROM pll GROUP BY 1, 2""")
def pl_history_rollup(spark, sf_dir):
    return CO.pl_history_rollup(D.pl_lines(spark, sf_dir))


@register("group_summary", "2.6", f"""WITH {CONS_CTE}
SELECT '{PL_PERIOD}' AS period,
       {', '.join(f"(SELECT sum(amount)::DECIMAL(28,2) FROM plc WHERE entity = 'CONSOLIDATED' AND period = '{PL_PERIOD}' AND line = '{ln}') AS {ln}" for ln in CO.PL_LINES + ('ebitda',))},
       {', '.join(f"(SELECT sum(amount)::DECIMAL(28,2) FROM bsc WHERE entity = 'CONSOLIDATED' AND line = '{ln}') AS total_{ln}" for ln in ('assets', 'liabilities', 'equity'))}""")
def group_summary(spark, sf_dir):
    return CO.group_summary(_pl(spark, sf_dir), _bs(spark, sf_dir), PL_PERIOD)
