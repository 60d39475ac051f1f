import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from ledgershield.llm import decontaminate as D

PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def slow(text, items, window):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        b = words(t)
        m = min(window, len(b))
        for at in range(len(b) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p:p + m] == b[at:at + m]:
                    hit.update(range(p, p + m))
                    ids.add(i)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@settings(max_examples=200, deadline=None)
@given(st.text("abAé 1.", max_size=40), st.lists(st.tuples(st.integers(0, 9), st.text("abé 1", max_size=20)), max_size=4), st.integers(1, 4))
def test_search_against_brute_force(text, items, window):
    n, spans, ids = D.Matcher([(str(i), t) for i, t in items], window).scan(text, [], [])
    want = slow(text, items, window)
    assert (n, int(np.sum(spans[1::2]) - np.sum(spans[::2])), len(ids)) == want[:3]


def test_edge_cases_and_blocks(spark, monkeypatch):
    bench = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short Item here"), (3, None), (4, "..."), (None, "no id item"), (1, "again w1"), (5, "w3 " * 30)]
    docs = [(1, "x W0 w1 w2 w3 w4 w5, w6 w7 w8 w9 w10 y short item\nHERE"), (2, None), (3, ""), (4, "no id item"), (5, "w3 " * 50_000),
            (5, "nothing"), (None, "again w1 z"), (7, "éw1 " * 3)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame([(*r, "extra") for r in docs], "doc_id long, text string, items string")
    want = sorted(((i, *(slow(t, bench, 10) if len(t or "") < 1000 else (50_000, 50_000, 1, hashlib.sha256(b"5").hexdigest(), True))) for i, t in docs), key=str)
    for chars in (2_000_000, 40):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        got = D.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        kept = D.drop_contaminated(d, b)
        assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7]
    assert D.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert D.contamination(d.limit(0), b).count() == 0
