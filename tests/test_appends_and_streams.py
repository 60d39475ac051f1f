"""Logs that grow, gaps, many part files, folder tables, several batches in any order, late dates."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgershield.operators import audit as AU
from ledgershield.operators import authz as AZ
from ledgershield.operators import treasury as TR
from ledgershield.session import scratch_path
from ledgershield.sources import domain as D
from ledgershield.streaming import jobs as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entries(spark):
    path = scratch_path(spark, f"entries-{uuid.uuid4().hex}")
    AU.build_entries(D.audit_calls(spark, SF)).write.parquet(path)
    return spark.read.parquet(path)


def facts(lines, log_cols=()):
    v = AU.verify_chain(lines, list(log_cols))
    return sorted(tuple(r) for r in v.select(*log_cols, "n_entries", "n_broken", "ok").collect())


@pytest.mark.parametrize("width", [1 << 20, 7])
def test_gaps_leave_one_first_entry(entries, width):
    gaps = entries.where(F.col("seq") % 10 != 3)
    linked = AU.link_chain(gaps, [], bucket_width=width).orderBy("seq").collect()
    assert [r["prev_hash"] for r in linked] == [None] + [r["hash"] for r in linked[:-1]]


def test_three_appends_verify(spark, entries):
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    part = entries.where(F.col("seq") % 3 != 1)
    AU.write_log(AU.link_chain(part.where("seq < 300"), []), path)
    AU.append_log(part.where("seq >= 300 and seq < 301"), path)
    AU.append_log(part.where("seq >= 301"), path)
    lines = AU.scan_log(spark, path)
    assert facts(lines) == [(part.count(), 0, True)]
    assert lines.where("prev_hash is null").count() == 1


def test_appends_to_tenant_logs_verify(spark, entries):
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    AU.write_log(AU.link_chain(entries.where("seq < 400"), ["tenant"]), path, ["tenant"])
    AU.append_log(entries.where("seq >= 400"), path, ["tenant"])
    got = facts(AU.scan_log(spark, path, ["tenant"]), ["tenant"])
    assert all(n_broken == 0 and ok for _, _, n_broken, ok in got) and sum(n for _, n, *_ in got) == entries.count()


def test_part_numbers_sort_as_numbers_and_blank_lines_do_not_count(spark, tmp_path):
    folder = tmp_path / "log" / "batch=0"
    folder.mkdir(parents=True)
    for part, line in ((99999, '{"request_id":"a"}'), (100000, '\t \n{"request_id":"b"}\n'), (100001, '{"request_id":"c"}')):
        (folder / f"part-{part:05d}-x.txt").write_text(line + "\n")
    rows = AU.scan_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r["seq"], r["request_id"]) for r in rows] == [(0, "a"), (1, "b"), (2, "c")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables as folders of six files, dealt out of order, with one empty file."""
    out = tmp_path_factory.mktemp("sf")
    for name in ("events", "lineitem", "orders", "customer"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.repartition(6, F.rand(3)).union(df.limit(0).coalesce(1)).write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.mark.parametrize(("delay", "max_files"), [("2 days", 1), ("0 days", 1), ("90 days", 2)])
def test_streams_over_folders_in_any_order(spark, folders, delay, max_files):
    want = D.ap_proposals(spark, SF).where("idempotency_key is not null").select("idempotency_key").distinct()
    got = S.stream_dedupe(spark, folders, delay, max_files)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    days = AU.kpi_by_day(AU.build_entries(D.audit_calls(spark, SF))).withColumn("day", F.to_date("day"))
    assert sorted(S.stream_kpi_daily(spark, folders, delay, max_files).collect()) == sorted(days.collect())


@pytest.mark.parametrize("width", [1 << 20, 5])
def test_chains_of_tenants_advance_in_parallel(spark, folders, width):
    chain = S.stream_audit_chain(spark, folders, max_files=1, bucket_width=width).select("tenant", "seq_in_log", "hash", "prev_hash")
    rows = chain.orderBy("tenant", "seq_in_log").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    for before, r in zip([None, *rows], rows):
        first = before is None or before["tenant"] != r["tenant"]
        assert (r["seq_in_log"], r["prev_hash"]) == ((0, None) if first else (before["seq_in_log"] + 1, before["hash"]))


def test_a_batch_that_runs_again_changes_nothing(spark):
    calls = D.audit_calls(spark, SF).withColumn("ts", F.to_timestamp("timestamp"))
    chain, days = S.ChainWriter(spark, "tenant"), S.DailyCalls(spark, "1 day")
    sink = scratch_path(spark, f"chain-{uuid.uuid4().hex}")
    for i in (0, 1, 1, 2, 2):
        part = calls.where(F.col("seq") % 3 == i)
        chain(part, i, sink), days(part, i)
    rows = spark.read.parquet(sink).drop("batch_id").orderBy("tenant", "seq_in_log").collect()
    assert len(rows) == calls.count() == len({r["hash"] for r in rows})
    assert [r["prev_hash"] for r in rows if r["seq_in_log"]] == [a["hash"] for a, b in zip(rows, rows[1:]) if b["seq_in_log"]]
    assert sum(r["calls"] for r in days.result().collect()) == calls.count()


def test_state_stays_bounded_over_many_batches(spark):
    """50 batches, a day each and some late rows: the states hold the days within the delay only."""
    rows = spark.range(2000).select(F.expr("cast(id % 1500 as string)").alias("idempotency_key"),
                                    F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id div 40 as int), 0, cast(id % 40 as int))").alias("ts")).cache()
    calls = rows.select("ts", F.lit("public").alias("tier"), F.expr("map('email', 2)").alias("redaction_stats"))
    keys, days = S.Deduplicator(spark, "3 days"), S.DailyCalls(spark, "3 days")
    held = []
    for i in range(50):
        mine = F.datediff("ts", F.lit("2024-01-01").cast("date")) == (i if i % 10 else max(0, i - 5))
        keys(rows.where(mine), i), days(calls.where(mine), i)
        held.append((keys.state.read("seen", i, S.KEYS).count(), days.state.read("open", i, S.DAYS).count()))
    assert max(k for k, _ in held[10:]) <= 4 * 40 and max(d for _, d in held[10:]) <= 4
    batches = [i if i % 10 else max(0, i - 5) for i in range(50)]
    got = {str(r["day"]): r["calls"] for r in days.result().collect()}
    assert sum(got.values()) == 50 * 40 and len(got) == len(set(batches))
    seen = rows.where(F.datediff("ts", F.lit("2024-01-01").cast("date")).isin(batches)).select("idempotency_key").distinct()
    assert keys.result().count() == seen.count() and keys.result().exceptAll(seen).count() == 0


def test_rates_hold_after_the_last_known_day(spark):
    rates = spark.createDataFrame([("EUR", "1999-01-05", 0.9), ("EUR", "1999-01-09", 0.8)], "ccy string, date string, rate_to_chf double") \
        .withColumn("date", F.to_date("date"))
    txns = spark.createDataFrame([("EUR", d, 100) for d in ("1999-01-04", "1999-01-05", "1999-01-08", "1999-01-09", "2031-12-31")] + [("CHF", "2040-01-01", 100)],
                                 "currency string, booking_date string, amount int").withColumn("booking_date", F.to_date("booking_date"))
    got = {(r["currency"], str(r["booking_date"])): r["amount_chf"] for r in TR.to_chf(txns, rates).collect()}
    assert [None if v is None else float(v) for _, v in sorted(got.items())] == [100, None, 90, 90, 80, 80]
    assert {r["ccy"]: float(r["rate_to_chf"]) for r in TR.rates_at(rates, "2050-01-01").collect()} == {"EUR": 0.8, "CHF": 1.0}


def test_amounts_are_judged_on_their_text(spark):
    texts = {"0": True, "-0": True, "-0.004": False, "0.004": True, "12345678901234567": True, "1e3": True, "-1e-9": False, "NaN": False,
             "Infinity": False, "": False, "12d": False, "1e400": True, " 5 ": True, None: False}
    props = spark.createDataFrame([(str(i), "ag", "t", "i", "a", x, "CHF", "e", "k") for i, x in enumerate(texts)],
                                  "proposal_id string, agent_id string, tenant_id string, invoice_id string, action string, amount_raw string, currency string, evidence_id string, idempotency_key string")
    first = AZ.check_contracts(D.ap_contracts(spark, SF)).where("valid").select("agent_id", "tenant_id", F.col("allowed_actions")[0].alias("action")).first()
    props = props.withColumn("agent_id", F.lit(first["agent_id"])).withColumn("tenant_id", F.lit(first["tenant_id"])).withColumn("action", F.lit(first["action"]))
    got = {int(r["proposal_id"]): r["valid"] for r in AZ.check_proposals(props, D.ap_contracts(spark, SF)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_old_payments_stay_pending(spark):
    p = D.pending_payments(spark, SF)
    o = spark.read.parquet(f"{SF}/orders.parquet").where(f"o_orderstatus = 'P' and to_date(o_orderdate) <= date '{D.AS_OF}'")
    assert p.count() == o.count() > 100
