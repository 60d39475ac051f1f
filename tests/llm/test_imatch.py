import hashlib
import re

import pytest

from ledgershield.llm import imatch as M


def neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out[d] = (len(t), hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("range_rows", [2000, 7])
def test_table(spark, monkeypatch, range_rows):
    monkeypatch.setattr(M, "RANGE_ROWS", range_rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in M.imatch(docs.repartition(3)).collect()}
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in rows.items()} == neighbours(texts.items())
    prints = {}
    for d, r in rows.items():
        assert prints.setdefault(texts[d], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for d, r in rows.items() if len(texts[d]) > 300]
    fresh = [r for r in long if r["near_next"] < 0.9]
    near, far = sorted(r["near_edited"] for r in long), sorted(r["near_next"] for r in fresh)
    assert near[len(near) // 2] > 0.3 and near[len(near) // 10] > far[-len(far) // 10], (near[::50], far[::50])


def test_likeness_is_the_share_of_equal_subsets(spark):
    rows = [(0, ["a", "b", "", ""], ["a", "", "", ""], 0, ["a", "c", "", "d"], ["a", "", "", ""]), (0, ["a", "b", "", ""], ["a", "x", "", ""], 1, ["a", "c", "", ""], [""] * 4),
            (0, ["a"] * 4, ["a"] * 4, 2, ["a"] * 4, ["a"] * 4), (1, [""] * 4, [""] * 4, 1, [""] * 4, [""] * 4)]
    df = spark.createDataFrame(rows, "l int, f array<string>, s array<string>, m int, g array<string>, t array<string>")
    df = df.selectExpr("named_struct('kind','b','level',l,'first',f,'second',s) a", "named_struct('kind','b','level',m,'first',g,'second',t) b")
    assert [r[0] for r in df.select(M.likeness(df.a, df.b)).collect()] == [1 / 3, 0.5, 0.0, 1.0]


def test_edge_cases(spark):
    rows = [(5, "alpha beta gamma delta " * 3), (None, None), (-3, ""), (9, "..."), (10, "é" * 9), (2**40, "word " * 100_000), (11, "𝒳𝒴𝒵𝒳 x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, range_ int, term string")
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in M.imatch(df).collect()}
    assert got == neighbours(rows)
    twice = M.imatch(df.union(df)).collect()
    assert len(twice) == 14 and len({r["fingerprint"] for r in twice if r["doc_id"] == 5}) == 1
    assert [r["near_next"] for r in twice if r["doc_id"] == 5 and r["near_next"] == 1.0]
    assert M.imatch(df.limit(0)).count() == 0
    one = M.imatch(df.filter("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def test_lexicon_is_bounded(spark):
    df = spark.createDataFrame([(" ".join(f"t{j}" for j in range(i)),) for i in range(200)], "text string")
    assert M.lexicon(df, "text", 0.5, 0.0).count() == 100 and 0 < M.lexicon(df, "text", 0.5, 0.0, most=50).count() <= 50


@pytest.mark.parametrize("ids", ["dense", "outlier", "equal", "null", "clusters"])
def test_ranges_follow_the_rows(spark, monkeypatch, ids):
    """One far id, equal ids or null ids: no range holds much more than its share, and neighbours stay right."""
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    id_of = {"dense": lambda i: i, "outlier": lambda i: i if i else 2**60, "equal": lambda i: 7, "null": lambda i: None,
             "clusters": lambda i: i % 2 * 10**15 + i}[ids]
    rows = [(id_of(i), f"text number {i} " * (1 + i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = M.with_next(df, "doc_id", "text").cache()
    sizes = [r["count"] for r in placed.filter("not guest_").groupBy("range_").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 4 * 50 and len(sizes) >= 10
    order = sorted((r["id_"] is not None, r["id_"] or 0, r["hash_"], r["text_"], r["next_"]) for r in placed.filter("not guest_").collect())
    assert all(a[4] == b[3] for a, b in zip(order, order[1:] + order[:1]))


def test_fingerprint_against_plain_python(spark):
    """Equal sets of terms have one fingerprint; likeness is recomputed from the fingerprints' texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in M.imatch(docs).collect()}
    order = sorted(texts)
    same = {}
    for d in order:
        terms = frozenset(t for t in re.split(r"[\W_]+", texts[d].lower()) if t)
        same.setdefault(terms, set()).add(got[d]["fingerprint"])
    assert all(len(prints) == 1 for prints in same.values())            # the fingerprint depends on the set of terms alone

    def parts(f):
        kind, rest = f[0], f[1:]
        level, first, second = rest.split(":")
        return kind, int(level), first.split("."), second.split(".")

    def plain_likeness(f, g):
        if f == g:
            return 1.0
        (kf, lf, f1, f2), (kg, lg, g1, g2) = parts(f), parts(g)
        if kf != kg or abs(lf - lg) > 1:
            return 0.0
        x, y = (f1 if lf >= lg else f2), (g1 if lg >= lf else g2)
        either = sum(a != "" or b != "" for a, b in zip(x, y))
        return sum(a == b != "" for a, b in zip(x, y)) / either if either else 0.0
    for d, nxt in zip(order, order[1:] + order[:1]):
        assert got[d]["near_edited"] == pytest.approx(plain_likeness(got[d]["fingerprint"], got[d]["edited_fingerprint"]))
        assert got[d]["near_next"] == pytest.approx(plain_likeness(got[d]["fingerprint"], got[nxt]["fingerprint"]))
