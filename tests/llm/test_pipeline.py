"""Each stage on what its predecessor kept, against plain versions."""

import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from ledgershield.llm import toxicity as T
from ledgershield.llm.common import written
from test_decontaminate import slow as slow_hits
from test_pii import BASE, valid
from test_simhash import slow_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:-1])


def test_toxicity_goes(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(before) - set(after)
    assert all(after[d] == before[d] for d in after)
    toxic, clean = {d for d, y in labels.items() if y == 1}, {d for d, y in labels.items() if y == 0}
    assert len(gone & toxic) > 0.7 * len(toxic) and len(gone & clean) < 0.02 * len(clean)
    model = T.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(before, T.Scorer(model).scores([r["text"] for r in before.values()])))
    limit = {d: model.thresholds.get(r["lang"], model.threshold) for d, r in before.items()}
    assert all((score[d] >= limit[d]) == (d in gone) for d in before if abs(score[d] - limit[d]) > 0.01)


def test_one_of_each_component_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = {c for _, _, c in slow_components([(d, r["text"]) for d, r in before.items()])}
    assert set(after) == want and all(after[d] == before[d] for d in after)


def test_benchmark_passages_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    before, after = rows(stages[2]), rows(stages[3])
    for d, r in before.items():
        text = r["text"].lower()
        near = [i for i in items if any(w in text for w in re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]{9,}", i[1].lower()))]
        windows[d] = bool(near) and slow_hits(r["text"], near, 10)[4]
    assert set(after) == {d for d, hit in windows.items() if not hit} and any(windows.values())


def test_personal_data_is_masked(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not any(valid(k, m[0]) for k, p in BASE.items() for m in re.finditer(p, r["text"]))
        assert r["n_chars"] == len(r["text"]) if r["text"] != before[d]["text"] else r == before[d]


def test_packing_covers_the_rest(stages):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    lengths = {}
    used = {}
    for r in stages[5].collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths == {d: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows(stages[4]).items()}
    for v in used.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_nulls_and_empty_tables(spark, stages):
    odd = spark.createDataFrame([(10**6 + k, t, None, None, None) for k, t in enumerate([None, "", "x", "mail a@b.co"])], stages[0].schema)
    for docs in (odd, stages[0].limit(0)):
        for _, stage in C.STAGES:
            docs = written(stage(spark, docs, SF), "odd")
        docs.collect()
