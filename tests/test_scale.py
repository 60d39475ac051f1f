"""Scale properties: same answers with 1 and 200 shuffle partitions; no
single-partition exchange in the plans of big-table queries."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["route_decision", "chain_link", "join_fx_asof", "flows_by_entity", "join_recon_match",
        "cash_forecast", "tvl_series", "peer_rank"]


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("key", KEYS)
def test_partition_count_invariance(spark, key):
    q = E.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = _rows(q(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        b = _rows(q(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


@pytest.mark.parametrize("key", ["chain_link", "join_fx_asof", "redact_messages", "join_recon_match"])
def test_no_single_partition_exchange(spark, key):
    plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_prompts_are_redacted_once(spark):
    """Queries that read redacted prompts twice don't redact them twice (one ``inline`` per redaction)."""
    for key in ("rehydrate", "join_rules"):
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate inline(") <= 1, key
