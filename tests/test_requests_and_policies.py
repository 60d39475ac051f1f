"""Policies as files, own rule types and detectors, forced backend, forecast grid, log files."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgershield.functions.patterns import DETECTORS, Detector
from ledgershield.functions.timing import elapsed_ms
from ledgershield.operators import audit as AU
from ledgershield.operators import payables as PY
from ledgershield.operators import redaction as RD
from ledgershield.operators import routing as RT
from ledgershield.session import scratch_path
from ledgershield.sources import domain as D
from ledgershield.sources import files

SF = "/root/testdata/sf0.001"


def test_policy_files(spark):
    folder = scratch_path(spark, f"policies-{uuid.uuid4().hex}")
    assert RT.load_policies(spark, folder).count() == 0
    files.put_once(spark, f"{folder}/none.yaml", "rules: []\nname: No rules\n")
    files.put_once(spark, f"{folder}/empty.yaml", "\n\n")
    files.put_once(spark, f"{folder}/own.yaml", "default_tier: private\nrules:\n- if_entity_in: [EMAIL, IBAN]\n  then_tier: sealed\n- if_words_over: 3\n  then_tier: public\n")
    files.put_once(spark, f"{folder}/notes.txt", "not a policy")
    got = {r["tenant"]: r for r in RT.load_policies(spark, f"file:{folder}").collect()}
    assert sorted(got) == ["empty", "none", "own"]
    assert got["none"]["rules"] == [] and got["none"]["name"] == "No rules"
    assert got["empty"]["name"] == "empty" and len(got["empty"]["rules"]) == 2
    assert [r["entity_in"] for r in got["own"]["rules"]] == [["EMAIL", "IBAN"], None] and got["own"]["rules"][1]["params"] == {"if_words_over": "3"}


def test_own_rule_type(spark):
    types = RT.with_rule_type("if_words_over", lambda rule, request: F.size(F.split(request["text"], " ")) > RT.param(rule, "if_words_over", "int"))
    pol = RT.policies_from_docs(spark, {"t": {"rules": [{"if_words_over": 3, "then_tier": "sealed"}, {"if_max_entities_gt": 0, "then_tier": "private"},
                                                        {"if_words_over": "many", "then_tier": "sealed"}]}})
    texts = spark.createDataFrame([(1, "t", "one two three"), (2, "t", "one two three four"), (3, "t", "a@b.ch"), (4, "u", "one two three four")], "id int, tenant string, text string")
    red = RD.redact_text(texts, "text").withColumn("explicit_tier", F.lit(None).cast("string"))
    tiers = {r["id"]: r["tier"] for r in RT.route(red, pol, rule_types=types).collect()}
    assert tiers == {1: "public", 2: "sealed", 3: "private", 4: "public"}
    assert {r["tier"] for r in RT.route(red, pol).collect()} == {"public", "private"}       # unknown types never fire
    with pytest.raises(ValueError):
        RT.with_rule_type("then_tier", lambda rule, request: F.lit(True))


def test_own_detector_and_backends(spark):
    docs = spark.createDataFrame([(1, "Ticket T-123 and T-124 by a@b.ch, T-123 again")], "doc_id int, text string")
    extra = DETECTORS + (Detector("TICKET", r"\bT-\d+\b", needles=("T-",)),)
    got = RD.redact_text(docs, "text", extra).first()
    assert got["redacted_text"] == "Ticket [TICKET_0001] and [TICKET_0002] by [EMAIL_0001], [TICKET_0001] again" and got["n_ticket"] == 2
    spans = spark.createDataFrame([(1, 0, 6, "WORD")], "doc_id int, start int, end int, entity_type string")
    assert RD.redact_documents(docs, spans).first()["backend"] == "spans"
    forced = RD.redact_documents(docs, spans, prefer="regex").first()
    assert forced["backend"] == "regex" and "[EMAIL_0001]" in forced["redacted_text"]
    assert RD.redact_documents(docs).first()["backend"] == "regex"
    for wrong in ("spans", "other"):
        with pytest.raises(ValueError):
            RD.redact_documents(docs, None, prefer=wrong)


def test_elapsed_ms_is_cut_off(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.000999", "2024-01-01 00:00:01.000998"), (None, "2024-01-01 00:00:00")], "a string, b string")
    assert [r[0] for r in df.select(elapsed_ms(F.to_timestamp("a"), F.to_timestamp("b"))).collect()] == [999, None]


def test_forecast_has_every_account_on_every_date(spark):
    accounts = spark.createDataFrame([("A", "o", "CHF", 100), ("B", "o", "CHF", -5), ("C", "o", "EUR", 50), ("X", "o", "???", 1)],
                                     "account_number string, owner string, currency string, balance_native int").withColumn("balance_native", F.col("balance_native").cast("decimal(18,2)"))
    rates = spark.createDataFrame([("CHF", 1.0), ("EUR", 0.5)], "ccy string, r double").select("ccy", F.col("r").cast("decimal(18,8)").alias("rate_to_chf"))
    inv = spark.createDataFrame([("A", "2020-01-02", 30, "open"), ("A", "2020-01-02", 30, "open"), ("A", "2020-01-03", 70, "open"), ("C", "2020-01-03", 20, "open"),
                                 ("C", "2020-01-03", 999, "paid"), ("C", "2020-01-01", 999, "open"), ("C", "2020-01-05", 999, "open"), ("C", None, 999, "open")],
                                "debit_account string, due_date string, gross int, status string") \
        .select("debit_account", F.to_date("due_date").alias("due_date"), F.col("gross").cast("decimal(18,2)").alias("gross"), "status", F.lit("2019-12-01").cast("date").alias("issue_date"))
    f = PY.cash_forecast(accounts, inv, rates, "2020-01-01", window_days=3)
    got = {}
    for r in f.orderBy("date").collect():
        got.setdefault(r["account_number"], []).append((float(r["outflow_chf"]), float(r["balance_chf"])) if r["balance_chf"] is not None else None)
    assert got == {"A": [(0, 100), (-60, 40), (-70, -30), (0, -30)], "B": [(0, -5)] * 4, "C": [(0, 25), (0, 25), (-10, 15), (0, 15)], "X": [None] * 4}
    flags = {r["account_number"]: (str(r["first_negative"]), float(r["lowest_balance_chf"])) for r in PY.shortfall_flag(f).collect()}
    assert flags == {"A": ("2020-01-03", -30), "B": ("2020-01-01", -5)}
    totals = [(r["n_accounts"], float(r["outflow_chf"]), float(r["balance_chf"])) for r in PY.forecast_totals(f).orderBy("date").collect()]
    assert totals == [(4, 0, 120), (4, -60, 60), (4, -80, -20), (4, 0, -20)]
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_log_files_are_of_bounded_size_and_in_order(spark):
    lines = spark.range(1000).select(F.col("id").alias("seq"), F.concat(F.lit('{"request_id":"'), F.col("id").cast("string"), F.lit('"}')).alias("value"))
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    AU.write_lines(lines, path, [], n_files=3, file_bytes=20 * 1024)           # 20 lines a file
    names = [n for n in files.names(spark, f"{path}/batch=0") if n.startswith("part-")]
    assert len(names) >= 50
    rows = AU.scan_log(spark, path).orderBy("seq").collect()
    assert [int(r["request_id"]) for r in rows] == list(range(1000)) and not any(r["corrupt"] for r in rows)
    assert AU.files_for(lines, 1 << 30) == 1 and AU.files_for(lines, 100) > 1


def test_corrupt_lines_are_marked_and_break_the_chain(spark, tmp_path):
    (tmp_path / "batch=0").mkdir()
    (tmp_path / "batch=0" / "part-00000-x.txt").write_text('{"hash":"a","prev_hash":null}\n{"hash":"b"\nnot json\n5\n\n{"hash":"c","prev_hash":"b"}\n')
    rows = AU.scan_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["corrupt"], r["hash"]) for r in rows] == [(False, "a"), (True, None), (True, None), (True, None), (False, "c")]
    assert [r["raw"] for r in rows][1:3] == ['{"hash":"b"', "not json"]


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_verification_at_bucket_borders(spark, width):
    e = AU.build_entries(D.audit_calls(spark, SF)).where("seq < 40")
    linked = AU.link_chain(e, [])
    cut = linked.withColumn("prev_hash", F.when(F.col("seq").isin(7, 8, 20), "x").otherwise(F.col("prev_hash")))
    for df, want in ((linked, (40, 0, None, True)), (cut, (40, 3, 7, False))):
        path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
        AU.write_log(df, path)
        got = AU.verify_chain(AU.scan_log(spark, path), bucket_width=width).first()
        assert (got["n_entries"], got["n_broken"], got["broken_at"], got["ok"]) == want


def test_a_day_is_filtered_at_the_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    day = AU.on_day(e, "2024-01-15")
    assert day.count() == e.where(F.to_date("ts") == "2024-01-15").count() > 0
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in day._jdf.queryExecution().toString()
