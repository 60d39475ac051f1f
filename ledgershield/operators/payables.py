"""Accounts payable and payments views: aging, per vendor / entity, summary,
open totals, pending payments, payment kind, bank-to-AP reconciliation,
cash position, cash forecast and shortfall.

Inputs: ``invoices`` (invoice_number, vendor, entity, currency, amount,
gross, debit_account, status, issue_date, due_date); ``rates`` = (ccy,
rate_to_chf) valid on the as-of day (3 rows, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .treasury import money

SUM = "decimal(28,2)"
# Aging bucket labels, in report order.
AGING_BUCKETS = ("current", "0-30", "31-60", "61-90", "90+", "unknown")
STUCK_DAYS = 7


def _d(s: str) -> Column:
    return F.lit(s).cast("date")


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(SUM)


def with_chf(df: DataFrame, rates: DataFrame, ccy_col: str = "currency", amount_col: str = "amount",
             out_col: str = "amount_chf") -> DataFrame:
    r = rates.select(F.col("ccy").alias("_ccy"), F.col("rate_to_chf").alias("_rate"))
    j = df.join(r, F.col(ccy_col) == F.col("_ccy"), "left")
    return j.withColumn(out_col, money(F.col(amount_col) * F.col("_rate"))).drop("_ccy", "_rate")


def open_as_of(invoices: DataFrame, as_of: str) -> DataFrame:
    """Invoices issued on or before the as-of day and not paid."""
    return invoices.where((F.col("status") == "open") & (F.col("issue_date") <= _d(as_of)))


def aging_bucket(due: Column, as_of: str) -> Column:
    """Days past due = as_of - due; due on the as-of day is still current
    (overdue is strict)."""
    days = F.datediff(_d(as_of), due)
    return (F.when(due.isNull(), "unknown").when(days <= 0, "current").when(days <= 30, "0-30")
            .when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+"))


def ap_aging(invoices: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Count and CHF amount per aging bucket of open invoices; every bucket
    listed, empty ones with zeros (left join from the fixed bucket list)."""
    spark = invoices.sparkSession
    buckets = spark.createDataFrame([(i, b) for i, b in enumerate(AGING_BUCKETS)], "bucket_no int, bucket string")
    op = with_chf(open_as_of(invoices, as_of), rates)
    g = (op.groupBy(aging_bucket(F.col("due_date"), as_of).alias("bucket"))
         .agg(F.count(F.lit(1)).alias("n_invoices"), _sum0(F.col("amount_chf")).alias("amount_chf")))
    j = buckets.join(g, "bucket", "left")
    return j.select("bucket_no", "bucket", F.coalesce("n_invoices", F.lit(0).cast("bigint")).alias("n_invoices"),
                    F.coalesce("amount_chf", F.lit(0).cast(SUM)).alias("amount_chf"))


def ap_by_vendor(invoices: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Per vendor: all invoices issued by as-of (count, CHF total) and the open part."""
    inv = with_chf(invoices.where(F.col("issue_date") <= _d(as_of)), rates)
    is_open = F.col("status") == "open"
    return (inv.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("n_invoices"), _sum0(F.col("amount_chf")).alias("total_chf"),
        F.count(F.when(is_open, 1)).alias("open_count"), _sum0(F.when(is_open, F.col("amount_chf"))).alias("open_chf")))


def ap_by_entity(invoices: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Per entity: open, overdue (due strictly before as-of) and paid counts and CHF."""
    inv = with_chf(invoices.where(F.col("issue_date") <= _d(as_of)), rates)
    is_open = F.col("status") == "open"
    overdue = is_open & (F.col("due_date") < _d(as_of))
    paid = F.col("status") == "paid"
    return (inv.groupBy("entity").agg(
        F.count(F.when(is_open, 1)).alias("open_count"), _sum0(F.when(is_open, F.col("amount_chf"))).alias("open_chf"),
        F.count(F.when(overdue, 1)).alias("overdue_count"),
        _sum0(F.when(overdue, F.col("amount_chf"))).alias("overdue_chf"),
        F.count(F.when(paid, 1)).alias("paid_count"), _sum0(F.when(paid, F.col("amount_chf"))).alias("paid_chf")))


def ap_summary(invoices: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """One row: open totals, overdue totals, top open entity, top vendor and
    the sorted entity list.  Built from the entity and vendor aggregates."""
    ent = ap_by_entity(invoices, rates, as_of)
    ven = ap_by_vendor(invoices, rates, as_of)
    e = ent.agg(F.sum("open_count").alias("open_count"), F.sum("open_chf").cast(SUM).alias("open_chf"),
                F.sum("overdue_count").alias("overdue_count"), F.sum("overdue_chf").cast(SUM).alias("overdue_chf"),
                F.max_by("entity", F.struct("open_chf", "entity")).alias("top_open_entity"),
                F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"))
    v = ven.agg(F.max_by("vendor", F.struct("total_chf", "vendor")).alias("top_vendor"))
    return e.join(v, how="cross")


def open_invoice_total(invoices: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Count of all open invoices; the CHF-only total the way the reference's
    summary computes it (other currencies not converted) and the converted total."""
    op = with_chf(open_as_of(invoices, as_of), rates)
    return op.agg(F.count(F.lit(1)).alias("open_count"),
                  _sum0(F.when(F.col("currency") == "CHF", F.col("amount"))).alias("total_chf_only"),
                  _sum0(F.col("amount_chf")).alias("total_converted_chf"))


def pending_payments(payments: DataFrame, as_of: str, threshold: int = STUCK_DAYS) -> DataFrame:
    """Payments awaiting authorisation: days_in_auth = as_of - execution date;
    stuck when it reaches the threshold (>=, our reading of the edge)."""
    d = F.datediff(_d(as_of), F.col("execution_date"))
    return payments.withColumn("days_in_auth", d).withColumn("is_stuck", d >= F.lit(threshold))


def pending_summary(pending: DataFrame, rates: DataFrame) -> DataFrame:
    p = with_chf(pending, rates, amount_col="value", out_col="value_chf")
    return p.agg(F.count(F.lit(1)).alias("n_pending"), F.count(F.when(F.col("is_stuck"), 1)).alias("n_stuck"),
                 _sum0(F.col("value_chf")).alias("pending_chf"))


# Fixed value: payroll references look like 'YYYY.MM_<person>'.
PAYROLL_REF = r"^\d{4}\.\d{2}_"


def payment_kind(paid: DataFrame) -> DataFrame:
    """payroll vs vendor, by our documented rule: reference 'YYYY.MM_<name>'
    and no invoice number means payroll."""
    payroll = F.col("reference").rlike(PAYROLL_REF) & (F.coalesce(F.col("invoice_number"), F.lit("")) == "")
    return paid.withColumn("kind", F.when(payroll, "payroll").otherwise("vendor"))


def vendor_key(c: Column) -> Column:
    """Normalised vendor name: lower case, letters and digits only."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def invoice_key(c: Column) -> Column:
    """Invoice number as text with a float-style trailing '.0' removed."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def _match_keys(df: DataFrame, prefix: str) -> DataFrame:
    return (df.withColumn(prefix + "vk", vendor_key(F.col("vendor")))
            .withColumn(prefix + "ik", invoice_key(F.col("invoice_number"))))


def reconcile(paid: DataFrame, invoices: DataFrame) -> DataFrame:
    """Bank-side vendor payments matched to AP invoices on normalised
    (vendor, invoice number, currency).  status: matched (amount equal),
    partial (paid less), overpaid, not_in_ap (no invoice: anti side).
    A shuffle equi-join on near-unique keys; AQE splits skewed partitions."""
    p = _match_keys(payment_kind(paid).where(F.col("kind") == "vendor"), "p_")
    a = _match_keys(invoices, "a_").select("a_vk", "a_ik", F.col("currency").alias("a_ccy"),
                                           F.col("amount").alias("ap_amount"),
                                           F.col("invoice_number").alias("ap_invoice_number"))
    j = p.join(a, (F.col("p_vk") == F.col("a_vk")) & (F.col("p_ik") == F.col("a_ik"))
               & (F.col("currency") == F.col("a_ccy")), "left")
    status = (F.when(F.col("ap_invoice_number").isNull(), "not_in_ap")
              .when(F.col("amount") == F.col("ap_amount"), "matched")
              .when(F.col("amount") < F.col("ap_amount"), "partial").otherwise("overpaid"))
    return j.select("vendor", "entity", "invoice_number", "currency", "amount", "paid_date",
                    "ap_invoice_number", "ap_amount", status.alias("status"))


def recon_anti(paid: DataFrame, invoices: DataFrame) -> DataFrame:
    """Vendor payments without any AP invoice (left anti join)."""
    p = _match_keys(payment_kind(paid).where(F.col("kind") == "vendor"), "p_")
    a = _match_keys(invoices, "a_").select("a_vk", "a_ik", F.col("currency").alias("a_ccy"))
    return p.join(a, (F.col("p_vk") == F.col("a_vk")) & (F.col("p_ik") == F.col("a_ik"))
                  & (F.col("currency") == F.col("a_ccy")), "left_anti").select(
        "vendor", "entity", "invoice_number", "currency", "amount", "paid_date")


def recon_semi(invoices: DataFrame, paid: DataFrame, as_of: str) -> DataFrame:
    """AP invoices still open on the as-of day although a payment exists (left semi)."""
    a = _match_keys(open_as_of(invoices, as_of), "a_")
    p = _match_keys(payment_kind(paid).where(F.col("kind") == "vendor"), "p_").select(
        "p_vk", "p_ik", F.col("currency").alias("p_ccy"))
    return a.join(p, (F.col("p_vk") == F.col("a_vk")) & (F.col("p_ik") == F.col("a_ik"))
                  & (F.col("currency") == F.col("p_ccy")), "left_semi").select(
        "invoice_number", "vendor", "entity", "currency", "amount", "due_date")


# -------------------------------------------------------------- cash ----

def cash_position(accounts: DataFrame, rates: DataFrame) -> DataFrame:
    """balance x rate -> CHF per account, then one aggregation with grouping
    sets: per currency, per owner and the group total (level column)."""
    a = with_chf(accounts, rates, amount_col="balance_native", out_col="balance_chf")
    by = [F.col("currency"), F.col("owner")]
    of_currency = F.grouping("currency") == 0
    return (a.groupingSets([[by[0]], [by[1]], []], *by)
            .agg(F.when(of_currency, "currency").when(F.grouping("owner") == 0, "owner").otherwise("total").alias("level"),
                 F.count(F.lit(1)).alias("n_accounts"),
                 F.when(of_currency, F.sum("balance_native").cast(SUM)).alias("balance_native"),
                 F.sum("balance_chf").cast(SUM).alias("balance_chf"))
            .select("level", "currency", "owner", "n_accounts", "balance_native", "balance_chf"))


def cash_forecast(accounts: DataFrame, invoices: DataFrame, rates: DataFrame, as_of: str,
                  window_days: int = 21) -> DataFrame:
    """Every account on the as-of day and on each of the ``window_days`` days after it: outflow = -sum(gross) of
    its open invoices due that day, in CHF at the account's rate (0 if none is due), and balance = CHF balance
    plus the outflows so far.  An account without a rate has null amounts.

    Invoices are summed per account into one column per day (one shuffle, partial sums on the map side), joined
    to the accounts once, and the days come out of the row by ``explode``: no window, no join of the grid."""
    op = open_as_of(invoices, as_of).withColumn("_day", F.datediff("due_date", _d(as_of))).where(F.col("_day").between(1, window_days))
    due = op.groupBy(F.col("debit_account").alias("account_number")) \
        .agg(F.array(*[F.sum(F.when(F.col("_day") == k, F.col("gross"))).cast(SUM) for k in range(1, window_days + 1)]).alias("_due"))
    acc = with_chf(accounts, rates, amount_col="balance_native", out_col="_now") \
        .join(rates.select(F.col("ccy").alias("currency"), "rate_to_chf"), "currency", "left")
    zero = F.when(F.col("rate_to_chf").isNotNull(), F.lit(0).cast("decimal(18,2)"))
    flows = F.transform("_due", lambda gross: F.coalesce(money(-gross * F.col("rate_to_chf")), zero))
    none = F.array_repeat(zero, window_days)
    j = acc.join(due, "account_number", "left") \
        .withColumn("_flows", F.concat(F.array(zero), F.coalesce(flows, none)))
    grid = j.select("account_number", "owner", "currency", "_now", "_flows", F.posexplode("_flows").alias("_k", "outflow_chf"))
    after = F.aggregate(F.slice("_flows", F.lit(1), F.col("_k") + 1), F.col("_now").cast(SUM), lambda so_far, x: (so_far + x).cast(SUM))
    return grid.select("account_number", "owner", "currency", F.date_add(_d(as_of), F.col("_k")).alias("date"), "outflow_chf",
                       after.alias("balance_chf"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Per forecast date over all accounts: accounts, outflow and balance after it (partial sums, one row per date)."""
    return forecast.groupBy("date").agg(F.count(F.lit(1)).alias("n_accounts"), _sum0(F.col("outflow_chf")).alias("outflow_chf"),
                                        _sum0(F.col("balance_chf")).alias("balance_chf"))


def shortfall_flag(forecast: DataFrame) -> DataFrame:
    """First forecast date on which an account's balance is negative (the as-of day if it is so already), and
    its lowest balance."""
    return (forecast.where(F.col("balance_chf") < 0).groupBy("account_number")
            .agg(F.min("date").alias("first_negative"), F.min("balance_chf").alias("lowest_balance_chf")))


def payments_summary(cash: DataFrame, forecast: DataFrame, open_total: DataFrame, pend: DataFrame,
                     recon: DataFrame) -> DataFrame:
    """One row rolling up cash, forecast, open invoices, pending payments and
    reconciliation; each input is a one-row (or tiny) aggregate."""
    c = cash.where(F.col("level") == "total").select(F.col("balance_chf").alias("cash_chf"))
    f = forecast_totals(forecast).agg(_sum0(F.col("outflow_chf")).alias("forecast_outflow_chf"),
                                      F.coalesce(F.max("n_accounts"), F.lit(0)).alias("forecast_accounts"))
    r = recon.agg(F.count(F.when(F.col("status") == "matched", 1)).alias("recon_matched"),
                  F.count(F.when(F.col("status") == "not_in_ap", 1)).alias("recon_not_in_ap"))
    return (c.join(f, how="cross").join(open_total, how="cross").join(pend, how="cross")
            .join(r, how="cross"))
