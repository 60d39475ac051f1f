"""Logs whose entries are laid out in order once: numbers, links and files as if each step had shuffled them."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgershield.operators import audit as AU
from ledgershield.session import scratch_path
from ledgershield.sources import domain as D


@pytest.fixture
def no_broadcast(spark):
    """Sizes at which no table is broadcast by its estimate."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def events(spark, n):
    """Events of which every fifth number comes twice with another value, with gaps, and with users missing."""
    i = F.col("id")
    return spark.range(n).select(
        (i - F.when(i % 5 == 1, 1).otherwise(0) + F.when(i >= n // 2, 10**9).otherwise(0)).alias("event_id"),
        F.timestamp_seconds(F.lit(1705000000) + i * 977).alias("ts"), F.when(F.floor(i / 5) % 31 != 30, F.floor(i / 5) % 3).alias("user_id"),
        F.when(i % 4 == 0, "error").otherwise("purchase").alias("event_type"), (i % 13).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (i % 7).cast("string"), F.lit(', "t": "'), F.when(i % 11 == 0, "é").otherwise("e"), F.lit('"}')).alias("props"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("key", ["chain_verify_tampered", "log_rotate"])
def test_entries_are_shuffled_once_and_lines_not_at_all(spark, tmp_path, monkeypatch, no_broadcast, key):
    events(spark, 500).write.parquet(str(tmp_path / "events.parquet"))
    seen, write = [], AU.write_lines
    monkeypatch.setattr(AU, "write_lines", lambda lines, *a, **k: (seen.append(lines), write(lines, *a, **k)))
    out = E.queries()[key](spark, str(tmp_path))
    log = "tenant" if key == "chain_verify_tampered" else "version"
    assert AU.lies_in_order(seen[0], [log], "seq")
    plan = final_plan(seen[0])
    assert plan.replace("], Exchange", "").count("Exchange rangepartitioning") == 1 and "ReusedExchange" in plan and "SortMergeJoin" not in plan
    assert "SortMergeJoin" not in final_plan(out)


@pytest.mark.parametrize("width,part_bytes", [(7, 1 << 10), (1, 1 << 12), (1 << 16, 1 << 20)])
def test_laid_out_log_is_in_order_and_verifies(spark, monkeypatch, no_broadcast, width, part_bytes):
    monkeypatch.setattr(AU, "LAID_BYTES", part_bytes)
    e = AU.build_entries(D.audit_calls(spark, "", events(spark, 600)))
    known = [r for r in e.select("tenant", "seq", "hash").collect() if r["tenant"] is not None]      # no log without a tenant
    assert len({(r["tenant"], r["seq"]) for r in known}) < len(known)
    laid = AU.link_chain(AU.dense_seq(e, ["tenant"], "seq", "at", width, lay_out=True), ["tenant"], "at")
    plain = AU.dense_seq(e.where("tenant is not null"), ["tenant"], "seq", "at", width)
    assert sorted(laid.select("tenant", "seq", "at").collect()) == sorted(plain.select("tenant", "seq", "at").collect())
    for n_files in (None, 3):                       # as the lines lie, and dealt out again
        path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
        AU.write_log(laid.drop("seq").withColumnRenamed("at", "seq"), path, ["tenant"], n_files=n_files)
        lines = AU.scan_log(spark, path, ["tenant"])
        rows = sorted(lines.select("tenant", "seq", "hash", "prev_hash").collect())
        assert len(rows) == len(known)
        for log in {r["tenant"] for r in known}:
            want = [r["hash"] for r in sorted((r for r in known if r["tenant"] == log), key=lambda r: (r["seq"], r["hash"]))]
            got = [r for r in rows if r["tenant"] == log]
            assert [r["seq"] for r in got] == list(range(len(want))) and [r["hash"] for r in got] == want
            assert [r["prev_hash"] for r in got] == [None, *want[:-1]]
        assert all(r["ok"] for r in AU.verify_chain(lines, ["tenant"], width).collect())
