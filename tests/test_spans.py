"""Span redaction: overlap clusters, token reuse, splice."""

import random
import time

from ledgershield.operators.spans import redact_by_spans


def test_overlaps_and_token_reuse(spark):
    text = "Anna Berg met Anna at Acme Corp today"
    #       0    5    10   15   20   25   30
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    spans = spark.createDataFrame([
        (1, 0, 4, "PERSON", "Anna"),
        (1, 0, 9, "PERSON", "Anna Berg"),     # same start, longer: wins the cluster
        (1, 5, 9, "PERSON", "Berg"),          # inside the longer one
        (1, 14, 18, "PERSON", "Anna"),
        (1, 22, 31, "ORG", "Acme Corp"),
        (1, 27, 37, "ORG", "Corp today"),     # overlaps the previous ORG: redacted with it
    ], "doc_id long, start int, end int, entity_type string, value string")
    rows = {r.doc_id: r for r in redact_by_spans(docs, spans).collect()}
    assert rows[1].redacted_text == "[PERSON_0001] met [PERSON_0002] at [ORG_0001]"
    assert dict(rows[1].stats) == {"PERSON": 2, "ORG": 1}
    assert rows[1].n_spans == 3
    assert rows[2].redacted_text == "nothing here" and rows[2].n_spans == 0


def test_repeated_value_reuses_token(spark):
    docs = spark.createDataFrame([(1, "Bob and Bob")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3, "PERSON", "Bob"), (1, 8, 11, "PERSON", "Bob")],
                                  "doc_id long, start int, end int, entity_type string, value string")
    r = redact_by_spans(docs, spans).collect()[0]
    assert r.redacted_text == "[PERSON_0001] and [PERSON_0001]"
    assert dict(r.stats) == {"PERSON": 1}


def test_no_character_of_any_span_survives(spark):
    rng = random.Random(8)
    docs, spans = [], []
    for d in range(60):
        n = rng.randint(5, 60)
        docs.append((d, "".join(chr(0x4E00 + 100 * d % 5000 + i) for i in range(n))))      # every character once
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, n - 2)
            b = rng.randint(a + 1, n)
            spans.append((d, a, b, rng.choice(["PERSON", "ORG", "LOC"]), docs[-1][1][a:b]))
    rows = redact_by_spans(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(spans, "doc_id long, start int, end int, entity_type string, value string")).collect()
    for r in rows:
        text = dict(docs)[r.doc_id]
        gone = {i for d, a, b, *_ in spans if d == r.doc_id for i in range(a, b)}
        assert [c for c in r.redacted_text if c in text] == [c for i, c in enumerate(text) if i not in gone]
        assert r.redacted_text.count("[") == r.n_spans


def test_one_value_under_two_types_has_one_token(spark):
    docs = spark.createDataFrame([(1, "Meier and Meier"), (2, "pay Anna Berg Carl Dorn now")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 5, "PERSON", "Meier"), (1, 10, 15, "ORG", "Meier"), (2, 4, 13, "ORG", "Anna Berg"), (2, 4, 8, "PERSON", "Anna"),
                                   (2, 9, 18, "ORG", "Berg Carl"), (2, 14, 23, "ORG", "Carl Dorn")],
                                  "doc_id long, start int, end int, entity_type string, value string")
    got = {r.doc_id: r.redacted_text for r in redact_by_spans(docs, spans).collect()}
    assert got == {1: "[PERSON_0001] and [PERSON_0001]", 2: "pay [ORG_0001] now"}

def test_long_text_of_many_spans(spark):
    """Every word of a long text is a span: the work must grow with the text, not with its square or cube."""
    words = [f"Na{i % 4000}é𝒳" for i in range(12000)]
    docs = spark.createDataFrame([(1, " ".join(words) + " end"), (None, "Nobody"), (2, None), (3, "")], "doc_id long, text string")
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    spans = spark.createDataFrame([(1, s, s + len(w), "PERSON" if i % 2 else "ORG") for i, (s, w) in enumerate(zip(starts, words))],
                                  "doc_id long, start int, end int, entity_type string")
    began = time.monotonic()
    got = sorted(((r.doc_id, r.n_spans, r.redacted_text, dict(r.stats)) for r in redact_by_spans(docs, spans).collect()),
                 key=lambda r: r[0] or 0)
    assert time.monotonic() - began < 60
    whole = " ".join(f"[{'PERSON' if i % 2 else 'ORG'}_{i % 4000 // 2 + 1:04d}]" for i in range(12000)) + " end"
    assert got == [(None, 0, "Nobody", {}), (1, 12000, whole, {"ORG": 2000, "PERSON": 2000}), (2, 0, None, {}), (3, 0, "", {})]
