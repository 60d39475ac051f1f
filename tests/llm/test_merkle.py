"""Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgershield.llm import merkle
from ledgershield.llm.merkle import fold, leaf_digest, manifest, proof_digest
from ledgershield.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes, fan):
    """(root, path of every leaf)"""
    paths, below = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, leaves = [], []
        for a in range(0, len(hashes), fan):
            run = hashes[a:a + fan]
            for k, members in enumerate(below[a:a + fan]):
                for i in members:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha(*run))
            leaves.append(sum(below[a:a + fan], []))
        hashes, below = up, leaves
    return hashes[0], paths


def brute(rows, fan=3):
    """Rows of the query, for rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees.append((own, *tree([leaf(r) for r in own], fan)))
    if not trees:
        return []
    root, above = tree([t[1] for t in trees], fan)
    out = []
    for (own, subroot, paths), rest in zip(trees, above):
        for r, path in zip(own, paths):
            path = path + rest
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", "")) if chosen else r)
            for before, after in path:
                node = sha(before, node, after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in path)), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
        got = [tuple(r) for r in QUERIES["op11_merkle"](spark, sf).collect()]
        assert sorted(got) == sorted(brute(rows))


@pytest.mark.parametrize(("fan", "levels"), [(3, 1), (3, 2), (2, 3), (4, 1)])
def test_buckets_below_buckets(spark, monkeypatch, fan, levels):
    """Small buckets: several passes, runs of every length, one source with most rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(fan * 10 + levels)
    rows = [(i * 7, f"s{min(rnd.randrange(12), rnd.randrange(12), 4)}" if i % 50 else None, None, i, f"t{i}") for i in range(170)]
    rnd.shuffle(rows)
    out = manifest(spark.createDataFrame(rows, SCHEMA), fan=fan)
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold(F.col("path"), F.col("leaf"))).collect()]
    assert sorted(got) == sorted((*r[:5], r[3]) for r in brute(rows, fan))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (None, "", None, 0, "0"), (5, "é", "x", 1, "a\nb"), (5, "é", "x", 1, "a\nb"),
            (5, "é", "x", 1, "other"), (6, "z", None, 2, "long \n" * 50_000), (7, "ｚ", None, 2, ""), (8, "𝄞", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("pos", "total", "hash", "key", "leaf", "tie", "bucket")})
    out = manifest(df)
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path"))).collect()]
    assert order(got) == order(r[:5] for r in brute(rows))
    assert manifest(df.limit(0)).count() == 0
    one = manifest(df.filter("doc_id = 8")).collect()[0]
    assert one["path"] == [] and one["leaf"] == one["subroot"] == one["root"]


def test_fields_cannot_run_into_each_other(spark):
    df = spark.createDataFrame([("1:a", None), ("1", ":a"), (None, "1:a"), ("-", None)], "a string, b string")
    assert df.select(leaf_digest(F.col("a"), F.col("b"))).distinct().count() == 4


def test_any_change_of_a_leaf_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = manifest(docs, carry=[("changed", leaf_digest(*[F.concat("text", F.lit(" ")) if f == "text" else F.col(f) for f in FIELDS]))])
    bad = out.select((fold(F.col("path"), F.col("leaf")) == F.col("root")).alias("same"), (fold(F.col("path"), F.col("changed")) == F.col("root")).alias("other"))
    assert bad.filter("not same or other").count() == 0
