"""Domain views derived from the input tables.

Every view is a lazy DataFrame over the parquet tables, so its size grows with
them.  The derivation rules (which table column becomes which domain column)
DuckDB oracle CTEs in ``ledgershield.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def _s(c: Column) -> Column:
    return c.cast("string")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(_s(c), n, "0")


def tenant_of(key: Column, n: int = 4) -> Column:
    return F.concat(F.lit("t"), _s(key % n))


def request_id_of(key: Column, kind: str) -> Column:
    """Deterministic request id: 'req_' + 16 hex chars of sha256(kind:key)."""
    return F.concat(F.lit("req_"), F.substring(F.sha2(F.concat(F.lit(kind + ":"), _s(key)), 256), 1, 16))


def currency_of(nationkey: Column) -> Column:
    m = nationkey % 3
    return F.when(m == 0, "CHF").when(m == 1, "EUR").otherwise("USD")


# ---------------------------------------------------------------- requests --

def prompt_requests(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One request per order, with a prompt that carries finance entities.

    Which sentences appear depends on the order key, so every detector and
    every routing rule is exercised.  Columns: request_id, o_orderkey, tenant,
    user_name, explicit_tier, model, max_tokens, text.
    """
    o = (orders if orders is not None else table(spark, sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name",
                                                 "c_nationkey")
    j = o.join(c, "o_custkey", "inner")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    vendor = F.concat(F.lit("Vendor"), _s(ck), F.lit(" AG"))
    text = F.concat(
        F.when(k % 4 != 3, F.concat(F.lit("Invoice from "), vendor)).otherwise(F.lit("Invoice")),
        F.when(k % 2 == 0, F.concat(F.lit(" for CHF "), _s(F.floor(F.col("o_totalprice")))))
         .otherwise(F.lit(" for a small amount")),
        F.when(k % 7 == 0, F.concat(F.lit(", account "), _pad(ck % 100, 2), F.lit("."), _pad(k % 1000, 3),
                                    F.lit("."), _pad(ck % 1000, 3), F.lit("."), _pad((k * 7) % 1000, 3),
                                    F.lit("."), _s(k % 10))).otherwise(F.lit("")),
        F.when(k % 11 == 0, F.concat(F.lit(", ref zv"), F.date_format(F.col("o_orderdate"), "yyyyMMdd"),
                                     F.lit("/"), _pad(k % 1000000, 6), F.lit("/"), _s(ck % 9 + 1)))
         .otherwise(F.lit("")),
        F.when(k % 5 == 0, F.concat(F.lit(", IBAN CH"), _pad(F.col("c_nationkey"), 2), F.lit(" "),
                                    _pad(ck % 10000, 4), F.lit(" "), _pad(k % 10000, 4), F.lit(" "),
                                    _pad((k * 13) % 10000, 4), F.lit(" "), _s(k % 10)))
         .otherwise(F.lit("")),
        F.when(k % 13 == 0, F.concat(F.lit(", card 4"), _pad(k % 1000, 3), F.lit(" "), _pad(ck % 10000, 4),
                                     F.lit(" 1111 "), _pad(k % 10000, 4))).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.concat(F.lit(". Contact ap"), _s(ck), F.lit("@vendor"), _s(ck % 50),
                                    F.lit(".example.com"))).otherwise(F.lit("")),
        F.when(k % 6 == 0, F.concat(F.lit(". Again "), vendor, F.lit("."))).otherwise(F.lit(".")),
    )
    explicit = F.when(k % 20 == 0, F.lit("sealed")).when(k % 97 == 0, F.lit("gold"))
    model = F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("model-"), F.lower(F.col("o_orderstatus"))))
    return j.select(
        request_id_of(k, "order").alias("request_id"),
        k.alias("o_orderkey"),
        tenant_of(ck).alias("tenant"),
        F.col("c_name").alias("user_name"),
        explicit.alias("explicit_tier"),
        model.alias("model"),
        F.when(k % 8 == 0, F.lit(None)).otherwise((k % 4 + 1) * 256).cast("int").alias("max_tokens"),
        text.alias("text"),
    )


def call_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of the call that each order's prompt makes: o_orderkey, started_at, finished_at."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("day"))
    k = F.col("o_orderkey")
    start = F.unix_micros("day") + (k % 86400) * 1000000 + k % 1000003
    return o.select("o_orderkey", F.timestamp_micros(start).alias("started_at"),
                    F.timestamp_micros(start + (k * 7919) % 4000000).alias("finished_at"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form messages: request_id, conv_id, turn, role, text, tenant,
    block_type ('text', or 'image' for every seventh (conv_id + turn): a
    non-text content block, classified as '' and passed through)."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        request_id_of(F.col("conv_id"), "conv").alias("request_id"),
        "conv_id", "turn", "role", "text",
        tenant_of(F.col("conv_id")).alias("tenant"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 6, "image").otherwise("text").alias("block_type"),
    )


# ------------------------------------------------------------------ policy --

def policy_catalog() -> dict:
    """Tenant policy documents for the four test tenants (as parsed YAML).

    ``None`` = no policy file (all defaults).  t3 has an explicit empty rule
    list, which means *no rules*, unlike a missing ``rules`` key.
    """
    from ..functions.patterns import DEMO_POLICY
    return {
        "t0": DEMO_POLICY,
        "t1": None,
        "t2": {"name": "Strict Tenant", "default_tier": "private",
               "allow_tier_override_via_header": False,
               "rules": [{"if_max_entities_gt": 2, "then_tier": "sealed"},
                         {"if_entity_in": ["email", "VENDOR"], "then_tier": "private"},
                         {"if_entity_in": ["AMOUNT"]}]},
        "t3": {"name": "Quiet Tenant", "default_tier": "public", "rules": []},
    }


# ------------------------------------------------------------------- audit --

def audit_calls(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Gateway calls to be written to the audit log, one per event.

    seq = event_id (events are in timestamp order), tenant from user, tier from
    event type, duration from value; error events carry an error and no response.
    """
    e = events if events is not None else table(spark, sf_dir, "events")
    et = F.col("event_type")
    is_err = et == "error"
    kv = F.get_json_object(F.col("props"), "$.k").cast("int")
    stats = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("email").alias("k"), (kv % 3).alias("v")),
        F.struct(F.lit("vendor").alias("k"), (kv % 2).alias("v"))), lambda x: x["v"] > 0))
    tier = (F.when(et.isin("purchase", "signup"), "private").when(is_err, "sealed").otherwise("public"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        tenant_of(F.col("user_id")).alias("tenant"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), _s(F.col("user_id"))))
         .alias("user"),
        tier.alias("tier"),
        F.lit("model-a").alias("model"),
        request_id_of(F.col("event_id"), "event").alias("request_id"),
        F.col("props").alias("prompt_text"),
        F.when(is_err, F.lit(None)).when(F.col("value") < 1, F.lit(""))
         .otherwise(F.concat(F.lit("answer "), _s(F.col("value").cast("decimal(12,2)")))).alias("response_text"),
        F.when(tier == "private", F.concat(F.lit("redacted "), F.col("props"))).alias("redacted_prompt_text"),
        stats.alias("redaction_stats"),
        (F.col("value") * 10).cast("int").alias("duration_ms"),
        F.when(is_err, "error").otherwise("ok").alias("status"),
        F.when(is_err, F.concat(F.lit("upstream failure "), _s(kv))).alias("error"),
        F.lit("gw-host-1").alias("host"),
    )


# ----------------------------------------------------------------- finance --

AS_OF = "1999-06-30"          # fixed as-of date for the finance views in tests


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP invoices: one per order.  entity = customer segment, vendor = customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                                                 "c_mktsegment")
    j = o.join(c, "o_custkey", "inner")
    k = F.col("o_orderkey")
    issue = F.to_date(F.col("o_orderdate"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return j.select(
        F.concat(F.lit("INV-"), _s(k)).alias("invoice_number"),
        F.concat(F.lit("Vendor "), _s(F.col("o_custkey") % 300)).alias("vendor"),
        F.col("c_mktsegment").alias("entity"),
        currency_of(F.col("c_nationkey")).alias("currency"),
        amount.alias("amount"),
        F.round(amount * F.lit(1.077).cast("decimal(4,3)"), 2).cast("decimal(18,2)").alias("gross"),
        F.concat(F.lit("ACC"), _s(F.col("o_custkey"))).alias("debit_account"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("open").alias("status"),
        issue.alias("issue_date"),
        F.when(k % 50 == 0, F.lit(None)).otherwise(F.date_add(issue, ((k % 3 + 1) * 30).cast("int")))
         .alias("due_date"),
    )


def cash_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash accounts: one per customer; owner = segment."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("ACC"), _s(F.col("c_custkey"))).alias("account_number"),
        F.col("c_mktsegment").alias("owner"),
        currency_of(F.col("c_nationkey")).alias("currency"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance_native"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(
            F.concat(_pad(F.col("c_custkey"), 6), _pad(F.col("c_nationkey"), 4))).alias("account_no"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily CHF rates per currency with gaps (ccy, date, rate_to_chf).

    Derived from lineitem: per (currency of the supplier's nation, ship date)
    rate = (9000 + (sum of discount cents mod 997)) / 10000.  Days whose
    day-of-month is divisible by 4 are missing, so carry-forward is exercised.
    CHF itself is not listed (rate 1).
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_discount")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = li.join(s, "l_suppkey")
    d = F.to_date(F.col("l_shipdate"))
    g = (j.select(currency_of(F.col("s_nationkey")).alias("ccy"), d.alias("date"),
                  F.round(F.col("l_discount") * 100).cast("bigint").alias("cents"))
         .where((F.col("ccy") != "CHF") & (F.dayofmonth(F.col("date")) % 4 != 0))
         .groupBy("ccy", "date")
         .agg(F.sum("cents").alias("c")))
    return g.select("ccy", "date",
                    ((F.lit(9000) + F.col("c") % 997) / F.lit(10000.0)).cast("decimal(18,8)").alias("rate_to_chf"))


def bank_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank transactions, one per line item.

    entity = customer's nation (reporting entity), bank = that nation's region,
    currency from the supplier nation, direction 'in' for returned lines.
    Counterparty = supplier name; for every tenth supplier it is the supplier's
    nation in lower case (another reporting entity: intercompany); blank for
    every 37th supplier.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber",
                                                 "l_extendedprice", "l_discount", "l_returnflag",
                                                 "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                 F.col("c_nationkey").alias("e_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name",
                                                 "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    ne = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("e_nationkey"), F.col("n_name").alias("entity"), F.col("r_name").alias("bank"))
    ns = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
    # lineitem x orders is the one big join (shuffle on the order key);
    # the others are dimension lookups, broadcast after a size check.
    j = li.join(o, "l_orderkey")
    j = j.join(c, "o_custkey")
    j = j.join(s, "l_suppkey")
    j = j.join(ne, "e_nationkey")
    j = j.join(ns, "s_nationkey")
    sk = F.col("l_suppkey")
    cp = (F.when(sk % 37 == 0, F.lit("")).when(sk % 10 == 0, F.lower(F.col("s_nation")))
          .otherwise(F.col("s_name")))
    # exact decimal arithmetic, rounded half-up once (same in the oracle)
    amount = F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                     * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)")
    return j.select(
        F.to_date(F.col("l_shipdate")).alias("booking_date"),
        "entity", "bank",
        currency_of(F.col("s_nationkey")).alias("currency"),
        cp.alias("counterparty"),
        F.when(F.col("l_returnflag") == "R", "in").otherwise("out").alias("direction"),
        amount.alias("amount"),
    )


def group_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporting entities of the group (normalised names)."""
    return table(spark, sf_dir, "nation").select(F.lower(F.trim(F.col("n_name"))).alias("name_key"))


# ----------------------------------------------------------- authorisation --

def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-invocation requests with their principal, one per order.

    principal tenant = customer tenant; the requested tenant is malformed for
    every 29th order and another tenant for every 31st; every 23rd principal is
    unverified and every 17th lacks 'model:invoke'.  Data class from order
    priority ('5-LOW' maps to an unknown class); model from order status.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = o.join(c, "o_custkey")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    pr = F.col("o_orderpriority")
    return j.select(
        request_id_of(k, "model").alias("request_id"),
        F.col("c_name").alias("subject"),
        tenant_of(ck).alias("principal_tenant"),
        (k % 23 != 0).alias("verified"),
        F.when(k % 17 == 0, F.array(F.lit("audit:read")))
         .otherwise(F.array(F.lit("model:invoke"), F.lit("audit:read"))).alias("permissions"),
        F.when(k % 29 == 0, F.concat(F.lit("-"), tenant_of(ck)))
         .when(k % 31 == 0, tenant_of(ck + 1)).otherwise(tenant_of(ck)).alias("tenant_id"),
        F.when(pr == "1-URGENT", "restricted").when(pr == "2-HIGH", "confidential")
         .when(pr == "3-MEDIUM", "internal").when(pr == "4-NOT SPECIFIED", "public")
         .otherwise("unclassified").alias("data_class"),
        F.when(k % 37 == 0, F.lit("")).when(F.col("o_orderstatus") == "F", "sealed")
         .when(F.col("o_orderstatus") == "O", "gpt").otherwise("claude").alias("requested_model"),
        (k % 19 != 0).alias("classification_complete"),
        (F.col("o_totalprice") < 300000).alias("redaction_complete"),
    )


def sovereign_policy_catalog() -> list[tuple]:
    """(tenant_id, allowed_external_models, allowed_external_classes, private_model,
    external_egress_enabled) for the test tenants; t1 has no policy (defaults)."""
    return [
        ("t0", ["gpt"], ["public", "internal"], "sealed", True),
        ("t2", ["gpt", "claude"], ["public"], "local-llm", True),
        ("t3", ["claude"], ["public", "internal", "confidential"], "sealed", False),
    ]


def sovereign_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        sovereign_policy_catalog(),
        "tenant_id string, allowed_external_models array<string>, allowed_external_classes array<string>, "
        "private_model string, external_egress_enabled boolean")


def ap_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One AP worker contract per supplier (agent 'ap-<suppkey>')."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    sk = F.col("s_suppkey")
    m = sk % 3
    actions = (F.when(m == 0, F.array(F.lit("payment.propose"), F.lit("invoice.extract")))
               .when(m == 1, F.array(F.lit("invoice.validate"), F.lit("purchase_order.match"),
                                     F.lit("gl_coding.propose")))
               .otherwise(F.array().cast("array<string>")))
    return s.select(
        F.concat(F.lit("ap-"), _s(sk)).alias("agent_id"),
        F.lit("1").alias("version"),
        F.when(sk % 23 == 0, F.lit("bad tenant!")).otherwise(tenant_of(sk)).alias("tenant_id"),
        actions.alias("allowed_actions"),
        F.lit("ap-manager").alias("supervisor"),
        (sk % 31 == 0).alias("may_approve"),
        (F.col("s_acctbal") > 9900).alias("may_release_payment"),
    )


def ap_proposals(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One AP action proposal per line item, by the agent of its supplier;
    ``proposed_at`` = ship date (event time for the streaming form)."""
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    sk, pk, lk = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    okey = _s(F.col("l_orderkey"))
    amt = _s(F.col("l_extendedprice").cast("decimal(18,2)"))
    action = (F.when(pk % 5 == 0, "invoice.extract").when(pk % 5 == 1, "invoice.validate")
              .when(pk % 5 == 2, "purchase_order.match").when(pk % 5 == 3, "gl_coding.propose")
              .otherwise("payment.propose"))
    return li.select(
        F.concat(okey, F.lit("-"), _s(lk), F.lit("-"), _s(pk)).alias("proposal_id"),
        F.concat(F.lit("ap-"), _s(sk)).alias("agent_id"),
        F.when(lk == 7, tenant_of(sk + 1)).otherwise(tenant_of(sk)).alias("tenant_id"),
        F.when(pk % 41 == 0, F.lit("")).otherwise(F.concat(F.lit("INV-"), okey)).alias("invoice_id"),
        action.alias("action"),
        F.when(pk % 53 == 0, F.lit("NaN")).when(pk % 59 == 0, F.concat(F.lit("-"), amt)).otherwise(amt)
         .alias("amount_raw"),
        F.when(sk % 43 == 0, F.lit("chf")).otherwise(currency_of(sk)).alias("currency"),
        F.concat(F.lit("EV-"), okey, F.lit("-"), _s(lk)).alias("evidence_id"),
        F.when(pk % 61 == 0, F.lit(None)).otherwise(F.concat(okey, F.lit(":"), _s(lk))).alias("idempotency_key"),
        F.col("l_shipdate").cast("timestamp").alias("proposed_at"),
    )


def paid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank-side payments: one per settled or partly settled order, written the
    way a bank statement shows them (vendor name without space, lower case;
    invoice number sometimes float-like 'INV-12.0'), plus one salary-like
    payment per supplier with no invoice (reference 'YYYY.MM_<name>').  Partly settled orders pay half,
    except every fourth, which pays in full."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                                                 "c_mktsegment")
    j = o.where(F.col("o_orderstatus").isin("F", "P")).join(c, "o_custkey")
    k = F.col("o_orderkey")
    full = (F.col("o_orderstatus") == "F") | (k % 4 == 0)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    amount = F.when(full, price).otherwise(F.round(price * F.lit(0.5).cast("decimal(2,1)"), 2).cast("decimal(18,2)"))
    inv = F.when(k % 2 == 0, F.concat(F.lit("INV-"), _s(k), F.lit(".0"))).otherwise(F.concat(F.lit("INV-"), _s(k)))
    vendor_pay = j.select(
        # every 17th payment carries a misspelt vendor name: no AP match
        F.concat(F.when(k % 17 == 0, F.lit("vendr")).otherwise(F.lit("vendor")), _s(F.col("o_custkey") % 300))
         .alias("vendor"),
        F.col("c_mktsegment").alias("entity"),
        inv.alias("invoice_number"),
        currency_of(F.col("c_nationkey")).alias("currency"),
        amount.alias("amount"),
        F.date_add(F.to_date(F.col("o_orderdate")), 45).alias("paid_date"),
        F.concat(F.lit("ZV "), _s(k)).alias("reference"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    salary = s.select(
        F.col("s_name").alias("vendor"),
        F.lit("HOUSEHOLD").alias("entity"),
        F.lit("").alias("invoice_number"),
        currency_of(F.col("s_nationkey")).alias("currency"),
        F.abs(F.col("s_acctbal")).cast("decimal(18,2)").alias("amount"),
        F.lit("1999-06-25").cast("date").alias("paid_date"),
        F.concat(F.lit("1999.06_"), F.regexp_replace(F.col("s_name"), "#", "")).alias("reference"))
    return vendor_pay.unionByName(salary)


def pending_payments(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Payments awaiting authorisation: partly settled orders whose execution date is on or before the
    as-of day, however long ago."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey",
                                                 "c_mktsegment")
    d = F.to_date(F.col("o_orderdate"))
    asof = F.lit(as_of).cast("date")
    o = o.where((F.col("o_orderstatus") == "P") & (d <= asof))
    j = o.join(c, "o_custkey")
    return j.select(
        F.concat(F.lit("PAY-"), _s(F.col("o_orderkey"))).alias("payment_id"),
        F.col("c_name").alias("beneficiary"),
        F.concat(F.lit("ACC"), _s(F.col("o_custkey"))).alias("debit_account"),
        F.col("c_mktsegment").alias("debit_entity"),
        currency_of(F.col("c_nationkey")).alias("currency"),
        F.to_date(F.col("o_orderdate")).alias("execution_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
    )


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank list: one bank per region plus an inventory-only custodian."""
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("bank"))
    return r.unionByName(spark.createDataFrame([("CUSTODY",)], "bank string"))


def inventory_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second account source (an inventory list, no transaction counts): one
    custody account per supplier nation and currency of the supplier."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = s.join(n, "s_nationkey").select(F.col("n_name").alias("entity"),
                                              currency_of(F.col("s_nationkey")).alias("currency")).distinct()
    return j.select("entity", F.lit("CUSTODY").alias("bank"), "currency",
                    F.concat_ws("-", F.upper(F.col("entity")), F.lit("CUSTODY"), F.col("currency")).alias("account"),
                    F.lit("inventory").alias("source"))


# ------------------------------------------------------------------ funds --

FUNDS_AS_OF = "2024-01-30"


def fund_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund flows: every event is a subscription into fund ``sp`` = event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("sp"), "ts", "user_id", "value")


def peer_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer universe: every user is a peer vault; class by user id modulo 3."""
    e = table(spark, sf_dir, "events")
    cls = F.when(F.col("user_id") % 3 == 0, "stable").when(F.col("user_id") % 3 == 1, "eth").otherwise("btc")
    return e.select(cls.alias("peer_class"), "user_id", "ts", "value")


def nav_package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV packages: one per (fund = order priority, month end); one report
    file per order plus one statement per investor (customer)."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_custkey")
    period = F.last_day(F.to_date("o_orderdate"))
    g = o.groupBy(F.col("o_orderpriority").alias("fund"), period.alias("period")).agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("o_custkey").alias("investor_statement_count"))
    return g.select(F.concat_ws(":", "fund", F.date_format("period", "yyyy-MM")).alias("package_id"),
                    "fund", "period", "investor_statement_count",
                    (F.col("n_files") + F.col("investor_statement_count")).alias("file_count"))


# ---------------------------------------------------------- consolidation --

def _region_of(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(key), "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("entity"))
    return n.join(r, "n_regionkey").select(key, "entity")


def pl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P&L lines per (entity = supplier region, quarter of ship date):
    revenues = net sales, cost_of_goods = -60 % of list price, opex = -tax."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = li.join(s, "l_suppkey").join(_region_of(spark, sf_dir, "s_nationkey"), "s_nationkey")
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    period = F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string"))
    g = j.groupBy("entity", period.alias("period")).agg(
        F.sum(F.round(ext * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)).alias("revenues"),
        (-F.sum(F.round(ext * F.lit(0.6).cast("decimal(2,1)"), 2))).alias("cost_of_goods"),
        (-F.sum(F.round(ext * F.col("l_tax").cast("decimal(4,2)"), 2))).alias("opex"))
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("line"), F.col(c).cast("decimal(28,2)").alias("amount"))
                             for c in ("revenues", "cost_of_goods", "opex")]))
    return g.select("entity", "period", st.alias("x")).select("entity", "period", "x.line", "x.amount")


def bs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance-sheet lines per entity (region): assets = positive customer
    balances, liabilities = negative ones (sign flipped), equity = supplier
    balances.  Plus the ADJUSTMENT pseudo-entity eliminating intra-group
    balances (suppliers with a balance above 9,000 are group companies) from
    assets and equity."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("b"))
    cj = c.join(_region_of(spark, sf_dir, "c_nationkey"), "c_nationkey")
    sj = s.join(_region_of(spark, sf_dir, "s_nationkey"), "s_nationkey")
    z = F.lit(0).cast("decimal(18,2)")
    ca = cj.groupBy("entity").agg(F.sum(F.when(F.col("b") > 0, F.col("b")).otherwise(z)).alias("assets"),
                                  (-F.sum(F.when(F.col("b") < 0, F.col("b")).otherwise(z))).alias("liabilities"))
    se = sj.groupBy("entity").agg(F.sum("b").alias("equity"))
    long_c = ca.select("entity", F.explode(F.array(
        F.struct(F.lit("assets").alias("line"), F.col("assets").cast("decimal(28,2)").alias("amount")),
        F.struct(F.lit("liabilities").alias("line"), F.col("liabilities").cast("decimal(28,2)").alias("amount"))))
        .alias("x")).select("entity", "x.line", "x.amount")
    long_s = se.select("entity", F.lit("equity").alias("line"), F.col("equity").cast("decimal(28,2)").alias("amount"))
    adj = s.where(F.col("b") > 9000).agg((-F.sum("b")).cast("decimal(28,2)").alias("amount"))
    long_a = adj.select(F.lit("ADJUSTMENT").alias("entity"),
                        F.explode(F.array(F.lit("assets"), F.lit("equity"))).alias("line"), "amount")
    return long_c.unionByName(long_s).unionByName(long_a)


# --------------------------------------------------------------- NER spans --

def ner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector spans over the documents, as an NER backend would emit them:
    every capitalised ASCII word is a PERSON span, every pair of adjacent
    capitalised words an ORG span (so spans overlap).  Word offsets come from a
    running sum of word lengths per document (window bounded by one document)."""
    from pyspark.sql import Window
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    w0 = d.select("doc_id", F.posexplode(F.split(F.col("text"), " ", -1)).alias("pos", "word"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    start = F.coalesce(F.sum(F.length("word") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cap = F.col("word").rlike("^[A-Z][a-z]+$")
    x = (w0.withColumn("start", start.cast("int")).withColumn("cap", cap)
         .withColumn("nw", F.lead("word").over(w)).withColumn("ncap", F.lead(cap).over(w)))
    def span(kind: str, end: Column, value: Column) -> Column:
        return F.struct(F.col("start"), end.alias("end"), F.lit(kind).alias("entity_type"), value.alias("value"))
    end = F.col("start") + F.length("word")
    person = span("PERSON", end, F.col("word"))
    org = span("ORG", end + 1 + F.length("nw"), F.concat_ws(" ", "word", "nw"))
    # both kinds in one pass: a union would sort and number the words twice
    return x.where("cap").select("doc_id", F.inline(F.when(F.col("ncap"), F.array(person, org)).otherwise(F.array(person))))
