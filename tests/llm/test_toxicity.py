import os
import subprocess
import sys

import zlib

import numpy as np
import pytest

from ledgershield.llm import toxicity as T


@pytest.fixture(scope="module")
def mid(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_rows_are_told_apart(spark, mid):
    docs, labels = mid
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id")        # all texts that have a label
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    model = T.fit(docs, labels)
    out = labelled.select("doc_id", T.score_column(model, labelled["text"]).alias("score")).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    y = np.array([truth[r["doc_id"]] for r in held])
    s = np.array([r["score"] for r in held])
    order = s.argsort().argsort()
    n1 = y.sum()
    assert (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1)) > 0.95
    assert y[s >= 0.7].mean() > 0.9 and (s[y == 1] >= 0.7).mean() > 0.7


def test_scores_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(3)
    m = T.Model(rng.standard_normal((T.BUCKETS, T.DIM)).astype(np.float32), [rng.standard_normal((k * T.DIM, T.FILTERS)).astype(np.float32) for k in T.WIDTHS],
                [rng.standard_normal(T.FILTERS).astype(np.float32) for _ in T.WIDTHS], rng.standard_normal(T.FILTERS * 3 + 1).astype(np.float32))
    texts = ["", "one", "some words to score here", "a b", None, "x " * 20 + "Stupidity"]

    def plain(text):
        b = T.Buckets()
        x = np.array([sum(m.embed[i] for i in b(w)) for w in T.words_of(text)]).reshape(-1, T.DIM)
        n = max(len(x), 1)
        x = np.concatenate((x, np.zeros((n - len(x) + 2, T.DIM))))
        tops = [np.maximum(np.array([x[p:p + k].ravel() @ w + c for p in range(n)]), 0).max(axis=0) for k, w, c in zip(T.WIDTHS, m.filters, m.bias)]
        return np.concatenate(tops) @ m.out[:-1] + m.out[-1]
    want = [plain(t) for t in texts]
    assert np.allclose(T.Scorer(m).logits(texts), want, atol=1e-3)
    old, T.SEGMENT = T.SEGMENT, 3
    try:
        assert np.allclose(T.Scorer(m).logits(texts), want, atol=1e-3)
    finally:
        T.SEGMENT = old


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, f"fine words number {i}" + " awful" * (i % 2), "en", 0.0) for i in range(60)]
                                 + [(100, None, None, 1.0), (100, "", "xx", 1.0), (None, "awful", "en", 1.0), (101, "ok " * 120_000 + "awful", "en", 0.0)],
                                 "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert min(score[i] for i in range(1, 60, 2)) > max(score[i] for i in range(0, 60, 2)) and score[101] > score[0]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(0, 60, 2))
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_all_labelled_rows_are_learned(spark):
    """A word that only rows beyond the first 2,500 of their class (by hash of the id) have is learned; so are the
    model's numbers the same however the rows are dealt to tasks."""
    from pyspark.sql import functions as F
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), T.held_out(F.col("id")).alias("held")).collect()
    train = sorted((r["h"], r["doc_id"]) for r in ids if not r["held"])
    late = {i for _, i in train[2500:]} | {r["doc_id"] for r in ids if r["held"]}
    rows = [(r["doc_id"], f"some fine words {r['doc_id'] % 97} " + ("zorgle" if r["doc_id"] in late else "awful"), "en") for r in ids]
    rows += [(10_000 + i, f"some fine words {i % 97} ok", "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 10_000)) for d, _, _ in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    awful, zorgle, fine = T.Scorer(model).scores(["some fine words awful", "some fine words zorgle", "some fine words ok"])
    assert min(awful, zorgle) > 0.7 and fine < 0.3
    other = T.fit(docs.repartition(7), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip((model.embed, *model.filters, *model.bias, model.out), (other.embed, *other.filters, *other.bias, other.out)))
    assert (model.scale, model.threshold, model.thresholds) == (other.scale, other.threshold, other.thresholds)


APART = """
import sys
sys.path.append({repo!r})                    # the driver alone: the workers' path comes from the environment
from ledgershield.session import build_session
spark = build_session("local[2]", 2)
import __spark_entry__
for name in {names!r}:
    rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count()
    print(name, rows)

def missing(_):
    try:
        import ledgershield
    except ImportError:
        return [1]
    return [0]
assert spark.sparkContext.range(1).mapPartitions(missing).first() == 1, "the workers could import the package"
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op8_toxicity", "op11_merkle", "op12_bpe", "op13_prefix_trie", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = APART.format(repo=repo, names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[0] in names] == names


def test_the_driver_makes_no_object_of_a_bucket(spark, monkeypatch):
    """Counts and changes of the buckets reach the driver as Arrow columns, not as rows, also where the session's
    ``toPandas`` does without Arrow (Spark's default)."""
    from pyspark.sql.classic.dataframe import DataFrame
    docs = spark.createDataFrame([(i, " ".join("".join(chr(97 + (i // 3 * 40 + j) // 26 ** k % 26) for k in range(6)) for j in range(40))
                                   + " awful" * (i % 2), "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    collect, made = DataFrame.collect, []

    def counted(self):
        rows = collect(self)
        made.append(len(rows))
        return rows
    monkeypatch.setattr(DataFrame, "collect", counted)
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")
    try:
        model = T.fit(docs, labels)
    finally:
        spark.conf.set(arrow, before)
    fresh = T.start_model(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.ones(2))
    learned = int((model.embed != fresh.embed)[:, 1:].any(axis=1).sum())
    assert learned > 1000 and made and max(made) < 1000


def test_embeddings_are_drawn_as_at_once():
    fresh = T.start_model(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.ones(2))
    rng = np.random.default_rng(7)
    want = (rng.standard_normal((T.BUCKETS, T.DIM)) * 0.05).astype(np.float32)
    assert np.array_equal(fresh.embed[:, 1:], want[:, 1:])
    assert np.array_equal(fresh.filters[0][1:], (rng.standard_normal((T.DIM, T.FILTERS)) * 0.1).astype(np.float32)[1:])
