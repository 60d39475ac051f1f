"""Native redaction vs a plain Python ``re`` re-implementation of the
reference behaviour, on edge texts; round trip and no residual hits."""

import re

from ledgershield.functions.patterns import DETECTORS, Detector
from ledgershield.functions.redact import redact, rehydrate_expr
from ledgershield.plans.gateway import prompt_messages
from pyspark.sql import functions as F

EDGE = [
    "", None, "plain text without anything",
    "Pay CHF 12345.50 to Acme Holding AG, IBAN CH93 0076 2011 6238 5295 7 today",
    "mail a.b@example.com and a.b@example.com and c@d.org",
    "card 4111 1111 1111 1111, again 4111 1111 1111 1111",
    "acct 12.345.678.901.2 ref ZV20240101/123456/7 and zv20240101/123456/8",
    "price $1 and \\ backslash, Müller Finanz GmbH paid EUR 2000",
    "adjacent: x@y.com,z@w.com",
    "Café Zürich SA owes GBP 99999",
]


def py_redact(text):
    """Sequential per-type replacement, one token per distinct value."""
    text = text or ""
    stats, toks = {}, {}
    for d in DETECTORS:
        flags = re.IGNORECASE if "i" in d.flags else 0
        seen = {}

        def sub(m, d=d, seen=seen):
            v = m.group(0)
            if v not in seen:
                seen[v] = "[%s_%04d]" % (d.entity, len(seen) + 1)
                toks[seen[v]] = v
            return seen[v]
        text = re.sub(d.pattern, sub, text, flags=flags)
        if seen:
            stats[d.entity.lower()] = len(seen)
    return text, stats, toks


def test_redaction_matches_python_re(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "id int, text string")
    rows = redact(df, "text").orderBy("id").collect()
    for r in rows:
        exp_text, exp_stats, _ = py_redact(EDGE[r.id])
        assert r.redacted_text == exp_text, (EDGE[r.id], r.redacted_text, exp_text)
        assert dict(r.stats) == exp_stats
        assert r.n_entities == sum(exp_stats.values())


def test_round_trip_and_no_residual_hits(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE) if t], "id int, text string")
    r = redact(df, "text").select("id", "text", "redacted_text",
                                  rehydrate_expr(F.col("redacted_text"), F.col("tokens")).alias("back"))
    for row in r.collect():
        assert row.back == row.text
        for d in DETECTORS[:2]:
            assert not re.search(d.pattern, row.redacted_text, re.IGNORECASE if "i" in d.flags else 0)


def test_corpus_differential(spark):
    """All sf0.001 documents: Spark vs Python re, text and stats."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = redact(docs, "text").select("doc_id", "text", "redacted_text", "stats").collect()
    assert rows
    for r in rows:
        t, s, _ = py_redact(r.text)
        assert r.redacted_text == t
        assert dict(r.stats) == s


def test_mark_and_quoted_tokens(spark):
    """The splitting mark in a text, one hit and several, and a type whose token has regex replacement signs."""
    own = Detector("A$1\\B", r"\bx\d+\b", start="x")
    texts = ["pay \x01 CHF 12345 and \x01EUR 2000\x01", "x1", "x1 and x2 and x1", "\x01 x7", "no hit \x01"]
    rows = redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", (*DETECTORS, own)).orderBy("i").collect()
    assert [r.redacted_text for r in rows] == ["pay \x01 [AMOUNT_0001] and \x01[AMOUNT_0002]\x01", "[A$1\\B_0001]",
                                               "[A$1\\B_0001] and [A$1\\B_0002] and [A$1\\B_0001]", "\x01 [A$1\\B_0001]", "no hit \x01"]
    assert [r.n_entities for r in rows] == [2, 1, 2, 1, 0]


def test_start_changes_no_match():
    for d in DETECTORS:
        flags = re.IGNORECASE if "i" in d.flags else 0
        for text in filter(None, EDGE):
            bare, led = (re.findall(p, text, flags) for p in (d.pattern, f"(?={d.start})" + d.pattern))
            assert bare == led


def test_no_lambda_holds_the_chain(spark):
    """The chain is plain projections: as nested lambdas it was evaluated expression by expression."""
    plan = redact(spark.createDataFrame([("a",)], "text string"), "text")._jdf.queryExecution().optimizedPlan().toString()
    generate = [line for line in plan.split("\n") if "Generate inline" in line]
    assert len(generate) == 1 and "regexp_extract_all" not in generate[0] and "lambda" not in generate[0]


def test_sole_hits(spark):
    """A sole hit whose characters also stand where the pattern does not match, overlap themselves, or were seen before."""
    own = Detector("ABA", r"(?<!x)aba", start="a")
    texts = ["pay xCHF 12345 or CHF 12345", "CHF 12345x, CHF 12345", "xaba aba", "aba xaba", "xababa aba", "aba", "é \\$1 aba $0", "CHF 12345 aba CHF 12345"]
    rows = redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", (*DETECTORS, own)).orderBy("i").collect()
    assert [r.redacted_text for r in rows] == ["pay xCHF 12345 or [AMOUNT_0001]", "CHF 12345x, [AMOUNT_0001]", "xaba [ABA_0001]", "[ABA_0001] xaba",
                                               "xab[ABA_0001] [ABA_0001]", "[ABA_0001]", "é \\$1 [ABA_0001] $0", "[AMOUNT_0001] [ABA_0001] [AMOUNT_0001]"]
    assert [r.n_entities for r in rows] == [1, 1, 1, 1, 1, 1, 1, 2]


def test_sole_hits_are_replaced_by_their_characters(spark):
    plan = redact(spark.createDataFrame([("a",)], "text string"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!_)position\(", plan)) == len(DETECTORS)


def test_messages_join_prompts_once(spark):
    """The three messages of a prompt come from one pass over orders and customers."""
    plan = prompt_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
