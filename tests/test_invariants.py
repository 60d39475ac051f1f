"""Cross-total invariants of the finance views (as in the snapshots)."""

from decimal import Decimal

import __spark_entry__ as E
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def q(spark, k):
    return E.queries()[k](spark, SF)


def test_aging_equals_open_total(spark):
    aging = sum(r.amount_chf for r in q(spark, "ap_aging").collect())
    tot = q(spark, "open_invoice_total").collect()[0]
    assert aging == tot.total_converted_chf
    assert sum(r.n_invoices for r in q(spark, "ap_aging").collect()) == tot.open_count


def test_internal_plus_external_is_total(spark):
    parts = q(spark, "intercompany_vs_external").collect()
    s = q(spark, "treasury_summary").collect()[0]
    assert sum(r.in_chf for r in parts) == s.in_chf
    assert sum(r.out_chf for r in parts) == s.out_chf
    assert sum(r.n_in + r.n_out for r in parts) == s.n_txns


def test_entity_view_equals_currency_view(spark):
    ent = q(spark, "flows_by_entity").where(F.col("level") == "currency")
    by_ccy = {r.currency: (r.i, r.o) for r in ent.groupBy("currency").agg(
        F.sum("in_native").alias("i"), F.sum("out_native").alias("o")).collect()}
    cur = {r.currency: (r.in_native, r.out_native) for r in q(spark, "flows_by_currency").collect()}
    assert by_ccy == cur


def test_monthly_sums_to_total(spark):
    m = q(spark, "cashflow_monthly").agg(F.sum("in_chf"), F.sum("out_chf"), F.sum("n_txns")).collect()[0]
    s = q(spark, "treasury_summary").collect()[0]
    assert (m[0], m[1], m[2]) == (s.in_chf, s.out_chf, s.n_txns)


def test_forecast_end_is_start_plus_outflows(spark):
    fc = q(spark, "cash_forecast")
    last = fc.groupBy("account_number").agg(F.max_by("balance_chf", "date").alias("end"),
                                            F.sum("outflow_chf").alias("out"),
                                            F.min_by("balance_chf", "date").alias("b0"),
                                            F.min_by("outflow_chf", "date").alias("o0"))
    for r in last.collect():
        assert r.end == r.b0 - r.o0 + r.out


def test_fiscal_year_is_sum_of_quarters(spark):
    fy = {(r.year, r.line): r.amount for r in q(spark, "pl_history_rollup").collect()}
    pl = q(spark, "pl_consolidation").where(F.col("entity") == "CONSOLIDATED")
    qs = {}
    for r in pl.collect():
        if r.line == "ebitda":
            continue
        k = (r.period[:4], r.line)
        qs[k] = qs.get(k, Decimal(0)) + r.amount
    assert qs == fy


def test_consolidated_is_sum_of_entities(spark):
    bs = q(spark, "bs_consolidation").collect()
    for line in ("assets", "liabilities", "equity"):
        ents = sum((r.amount or 0) for r in bs if r.line == line and r.entity != "CONSOLIDATED")
        cons = [r.amount for r in bs if r.line == line and r.entity == "CONSOLIDATED"][0]
        assert ents == cons


def test_position_shares_sum_to_one(spark):
    from ledgershield.operators import funds as FU
    from ledgershield.sources import domain as D
    pos = FU.positions(D.fund_flows(spark, SF)).groupBy("sp").agg(F.sum("share").alias("s"))
    for r in pos.collect():
        assert abs(r.s - 1.0) < 1e-9
