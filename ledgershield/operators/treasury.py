"""Treasury views over bank transactions: FX as-of conversion, flows by
currency / entity / month, intercompany classification, counterparties,
banks, companies and the group summary.

Input ``txns``: booking_date, entity, bank, currency, counterparty,
direction ('in' / 'out'), amount DECIMAL(18,2).  Input ``rates``: ccy, date,
rate_to_chf with gaps; CHF is implicit (rate 1).

Scale notes: the group keys here are few (entities, currencies, banks), so
every aggregate relies on map-side partial aggregation and never on a window
over transactions.  Rates are a calendar-sized table, filled per currency and
joined on (currency, date); Catalyst and AQE pick the join by its real size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MONEY = "decimal(18,2)"
RATE = "decimal(18,8)"


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


# ------------------------------------------------------------------ FX ----

def fx_fill(rates: DataFrame) -> DataFrame:
    """As-of rates: one row per (ccy, day) from the first to the last known rate of the currency, carrying
    the rate forward over gaps.

    Each rate is valid up to the day before the next one; the days are listed with ``sequence``, per
    currency over this small table only, never over the transactions.  Days before a currency's first rate
    have no row, so amounts on them convert to null (documented choice); days after its last rate keep
    that rate, whatever their date (see ``to_chf``)."""
    w = Window.partitionBy("ccy").orderBy("date")
    until = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date"))
    spans = rates.select("ccy", "date", F.col("rate_to_chf").cast(RATE).alias("rate_to_chf"), until.alias("until"))
    return spans.select("ccy", F.explode(F.sequence("date", "until")).alias("date"), "rate_to_chf")


def rates_at(rates: DataFrame, as_of: str) -> DataFrame:
    """(ccy, rate_to_chf) in force on one day: the last rate up to it; CHF included with rate 1."""
    day = (rates.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("ccy")
           .agg(F.max_by("rate_to_chf", "date").cast(RATE).alias("rate_to_chf")))
    chf = rates.sparkSession.createDataFrame([("CHF",)], "ccy string").select(
        "ccy", F.lit(1).cast(RATE).alias("rate_to_chf"))
    return day.unionByName(chf)


def rate_calendar(rates: DataFrame) -> DataFrame:
    """One row per currency: (_ccy, _first day, _rates of every day from then up to the last known one).

    At most currencies x calendar days numbers, whatever the transactions."""
    days = fx_fill(rates).groupBy(F.col("ccy").alias("_ccy")).agg(
        F.min("date").alias("_first"), F.array_sort(F.collect_list(F.struct("date", "rate_to_chf"))).alias("_days"))
    return days.select("_ccy", "_first", F.transform("_days", lambda x: x["rate_to_chf"]).alias("_rates"))


def to_chf(txns: DataFrame, rates: DataFrame, ccy_col: str = "currency", date_col: str = "booking_date",
           amount_col: str = "amount", out_col: str = "amount_chf") -> DataFrame:
    """As-of conversion: amount x the rate in force on the booking day.

    The calendar is bounded by currencies and days, so it is broadcast to the transactions; the rate is looked up by
    the number of days since the currency's first one.  Later days than the last have the last rate."""
    j = txns.join(F.broadcast(rate_calendar(rates)), F.col(ccy_col) == F.col("_ccy"), "left")
    day = F.datediff(F.col(date_col), F.col("_first"))
    known = F.when(day >= 0, F.get("_rates", F.least(day, F.size("_rates") - 1)))
    rate = F.when(F.col(ccy_col) == "CHF", F.lit(1).cast(RATE)).otherwise(known)
    return j.withColumn(out_col, money(F.col(amount_col) * rate)).drop("_ccy", "_first", "_rates")


def _in(c: str = "amount") -> Column:
    return F.when(F.col("direction") == "in", F.col(c))


def _out(c: str = "amount") -> Column:
    return F.when(F.col("direction") == "out", F.col(c))


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)")


# --------------------------------------------------------------- flows ----

def flows_by_currency(txns: DataFrame) -> DataFrame:
    """Native in / out / net / count per currency."""
    return (txns.groupBy("currency")
            .agg(_sum0(_in()).alias("in_native"), _sum0(_out()).alias("out_native"),
                 F.count(F.lit(1)).alias("n_txns"))
            .withColumn("net_native", F.col("in_native") - F.col("out_native")))


def flows_by_entity(conv: DataFrame) -> DataFrame:
    """Per (entity, currency) and per entity (currency null, level 'entity'):
    native and CHF in / out / net and counts.  The totals are summed from the
    rows per currency."""
    g = (conv.groupBy("entity", "currency").agg(
        _sum0(_in()).alias("in_native"), _sum0(_out()).alias("out_native"),
        _sum0(_in("amount_chf")).alias("in_chf"), _sum0(_out("amount_chf")).alias("out_chf"),
        F.count(_in()).alias("n_in"), F.count(_out()).alias("n_out")))
    # entity totals from the (small) per-currency result: native sums across
    # currencies have no meaning, so they are null on the total rows
    tot = (g.groupBy("entity").agg(
        F.sum("in_chf").cast("decimal(28,2)").alias("in_chf"), F.sum("out_chf").cast("decimal(28,2)").alias("out_chf"),
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
        .select("entity", F.lit(None).cast("string").alias("currency"),
                F.lit(None).cast("decimal(28,2)").alias("in_native"), F.lit(None).cast("decimal(28,2)").alias("out_native"),
                "in_chf", "out_chf", "n_in", "n_out"))
    out = g.withColumn("level", F.lit("currency")).unionByName(tot.withColumn("level", F.lit("entity")))
    return (out.withColumn("net_chf", F.col("in_chf") - F.col("out_chf"))
            .withColumn("net_native", F.col("in_native") - F.col("out_native")))


def cashflow_monthly(conv: DataFrame) -> DataFrame:
    """count, in, out, net (CHF) per booking month 'yyyy-MM'."""
    return (conv.groupBy(F.date_format("booking_date", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_txns"), _sum0(_in("amount_chf")).alias("in_chf"),
                 _sum0(_out("amount_chf")).alias("out_chf"),
                 F.count(F.when(F.col("amount").isNotNull() & F.col("amount_chf").isNull(), 1)).alias("n_unconverted"))
            .withColumn("net_chf", F.col("in_chf") - F.col("out_chf")))


# --------------------------------------------------------- intercompany ----

def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def classify_intercompany(conv: DataFrame, group_names: DataFrame) -> DataFrame:
    """Adds ``is_internal``: the counterparty is a reporting entity of the group
    (normalised-name lookup against the name list)."""
    names = group_names.select(F.col("name_key").alias("_nk")).distinct().withColumn("_hit", F.lit(True))
    j = conv.withColumn("_ck", name_key(F.col("counterparty"))).join(names,
                   F.col("_ck") == F.col("_nk"), "left")
    return j.withColumn("is_internal", F.coalesce(F.col("_hit"), F.lit(False))).drop("_ck", "_nk", "_hit")


def intercompany_pairs(classified: DataFrame) -> DataFrame:
    """Directed pairs payer -> payee of internal transfers with CHF sum and
    count.  The reporting entity is the payer of its outflows and the payee of
    its inflows; the other side is the lower-cased counterparty."""
    cp = name_key(F.col("counterparty"))
    out = F.col("direction") == "out"
    return (classified.where(F.col("is_internal"))
            .groupBy(F.when(out, F.col("entity")).otherwise(cp).alias("payer"),
                     F.when(out, cp).otherwise(F.col("entity")).alias("payee"))
            .agg(_sum0(F.col("amount_chf")).alias("amount_chf"), F.count(F.lit(1)).alias("n_txns")))


def intercompany_vs_external(classified: DataFrame) -> DataFrame:
    """In / out sums and counts for the internal and the external class."""
    return (classified.groupBy(F.when(F.col("is_internal"), "internal").otherwise("external").alias("class"))
            .agg(_sum0(_in("amount_chf")).alias("in_chf"), F.count(_in()).alias("n_in"),
                 _sum0(_out("amount_chf")).alias("out_chf"), F.count(_out()).alias("n_out")))


def top_counterparties(classified: DataFrame, k: int = 10) -> DataFrame:
    """External outflow per lower-cased counterparty, blanks left out; the k
    largest (the limit is the feature; ties broken by name)."""
    cp = name_key(F.col("counterparty"))
    return (classified.where(~F.col("is_internal") & (F.col("direction") == "out") & (cp != ""))
            .groupBy(cp.alias("counterparty"))
            .agg(_sum0(F.col("amount_chf")).alias("out_chf"), F.count(F.lit(1)).alias("n_txns"))
            .orderBy(F.desc("out_chf"), F.asc("counterparty")).limit(k))


# ------------------------------------------------------ banks, accounts ----

def account_of(entity: Column, bank: Column, ccy: Column) -> Column:
    return F.concat_ws("-", F.upper(entity), F.upper(bank), ccy)


def statement_accounts(txns: DataFrame) -> DataFrame:
    """Accounts seen on statements with their transaction count."""
    return (txns.groupBy("entity", "bank", "currency").agg(F.count(F.lit(1)).alias("txn_count"))
            .withColumn("account", account_of(F.col("entity"), F.col("bank"), F.col("currency")))
            .withColumn("source", F.lit("statement")))


def accounts_union(statement: DataFrame, inventory: DataFrame) -> DataFrame:
    """Two account sources with different columns (``txn_count`` only on
    statements): union by name, missing columns null."""
    return statement.unionByName(inventory, allowMissingColumns=True)


def account_flows(accounts: DataFrame, conv: DataFrame) -> DataFrame:
    """Accounts left-joined to their flow totals; ``has_flow_data`` flags
    accounts without any transaction.  Flows are aggregated before the join,
    so the join is account-sized on both sides."""
    f = (conv.groupBy(account_of(F.col("entity"), F.col("bank"), F.col("currency")).alias("account"))
         .agg(_sum0(_in("amount_chf")).alias("in_chf"), _sum0(_out("amount_chf")).alias("out_chf"),
              F.count(F.lit(1)).alias("n_txns")))
    j = accounts.join(f, "account", "left")
    return j.select("account", "entity", "bank", "currency", "source",
                    F.col("n_txns").isNotNull().alias("has_flow_data"),
                    F.coalesce("in_chf", F.lit(0).cast("decimal(28,2)")).alias("in_chf"),
                    F.coalesce("out_chf", F.lit(0).cast("decimal(28,2)")).alias("out_chf"),
                    F.coalesce("n_txns", F.lit(0).cast("bigint")).alias("n_txns"))


def by_bank(banks: DataFrame, conv: DataFrame) -> DataFrame:
    """Per bank: accounts, currencies, date range, in/out/net CHF, count and
    status; banks without data are kept with zeros and null dates."""
    f = (conv.groupBy("bank").agg(
        F.countDistinct(account_of(F.col("entity"), F.col("bank"), F.col("currency"))).alias("n_accounts"),
        F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"),
        F.min("booking_date").alias("first_date"), F.max("booking_date").alias("last_date"),
        _sum0(_in("amount_chf")).alias("in_chf"), _sum0(_out("amount_chf")).alias("out_chf"),
        F.count(F.lit(1)).alias("n_txns")))
    j = banks.select("bank").join(f, "bank", "left")
    z = F.lit(0).cast("decimal(28,2)")
    return j.select(
        "bank", F.coalesce("n_accounts", F.lit(0).cast("bigint")).alias("n_accounts"),
        F.coalesce("currencies", F.lit("")).alias("currencies"), "first_date", "last_date",
        F.coalesce("in_chf", z).alias("in_chf"), F.coalesce("out_chf", z).alias("out_chf"),
        (F.coalesce("in_chf", z) - F.coalesce("out_chf", z)).alias("net_chf"),
        F.coalesce("n_txns", F.lit(0).cast("bigint")).alias("n_txns"),
        F.when(F.col("n_txns").isNull(), "no_data").otherwise("ok").alias("status"))


def by_company(conv: DataFrame) -> DataFrame:
    """Per reporting entity: its accounts (array of records in order of the account), their number, and CHF totals.

    Transactions are summed per account first; a company's accounts are as many as its banks and currencies."""
    accounts = conv.groupBy("entity", "bank", "currency").agg(
        _sum0(_in("amount_chf")).alias("in_chf"), _sum0(_out("amount_chf")).alias("out_chf"), F.count(F.lit(1)).alias("n_txns"))
    record = F.struct(account_of(F.col("entity"), F.col("bank"), F.col("currency")).alias("account"), "bank", "currency", "in_chf", "out_chf", "n_txns")
    return accounts.groupBy("entity").agg(
        F.count(F.lit(1)).alias("account_count"), F.array_sort(F.collect_list(record)).alias("accounts"),
        *[F.sum(c).cast("decimal(28,2)").alias(c) for c in ("in_chf", "out_chf")], F.sum("n_txns").alias("n_txns")) \
        .withColumn("net_chf", F.col("in_chf") - F.col("out_chf"))


def treasury_summary(classified: DataFrame) -> DataFrame:
    """One row: accounts, date range, in/out/net CHF, count, top external
    counterparty by outflow and top entity by outflow.  The two 'top' values
    come from small per-key aggregates, not from the transactions."""
    tot = classified.agg(
        F.count(F.when(F.col("amount").isNotNull() & F.col("amount_chf").isNull(), 1)).alias("n_unconverted"),
        F.countDistinct(account_of(F.col("entity"), F.col("bank"), F.col("currency"))).alias("n_accounts"),
        F.min("booking_date").alias("first_date"), F.max("booking_date").alias("last_date"),
        _sum0(_in("amount_chf")).alias("in_chf"), _sum0(_out("amount_chf")).alias("out_chf"),
        F.count(F.lit(1)).alias("n_txns"))
    top_cp = top_counterparties(classified, 1).select(F.col("counterparty").alias("top_counterparty"))
    ent = (classified.where(F.col("direction") == "out").groupBy("entity")
           .agg(_sum0(F.col("amount_chf")).alias("o"))
           .agg(F.max_by("entity", F.struct("o", "entity")).alias("top_entity_by_out")))
    one = tot.join(top_cp, how="left").join(ent, how="left")
    return one.withColumn("net_chf", F.col("in_chf") - F.col("out_chf"))
