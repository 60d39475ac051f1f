import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from ledgershield.llm import packing as K
from ledgershield.llm.tokens import encoder

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abAB é ,.  \n\t'sñ12#_\xa0日º²x-\x01\x03<|>", max_size=30), max_size=5))
@example(["a, b. c.\nD e.\n F ., x <|endoftext|> ²| ."])
def test_ids_are_the_librarys(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_the_librarys, "t") else test_ids_are_the_librarys.t
    test_ids_are_the_librarys.t, t.encode_special_tokens = t, True
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(encoder(PATH)().encode(texts)) == want


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    used = {}
    numbers = {n: [] for n in counts}
    for n, first, k, bin_, offset in K.plan_bins(counts, 20):
        for i in range(k):
            numbers[n].append(first + i)
            used.setdefault(bin_ + i, []).append((offset, n))
    assert all(sorted(v) == list(range(counts[n])) for n, v in numbers.items())
    for v in used.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 20
    assert sorted(20 - sum(n for _, n in v) for v in used.values()) == best_fit_decreasing(lengths, 20)
    assert sorted(used) == list(range(len(used)))


def check(rows, docs, library, capacity):
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    used, cuts = {}, {}
    for r in rows:
        cuts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, texts in ids.items():
        want = []
        for x in texts:
            first = (len(x) - 1) % capacity + 1
            edges = [0, *range(first, len(x) + 1, capacity)]
            want += [(k, a, z - a, zlib.crc32(x[a:z].tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
        assert sorted(want) == sorted(cuts.pop(d))
    assert not cuts
    for v in used.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
    return len(used)


def test_documents(spark, library, monkeypatch):
    monkeypatch.setattr(K, "GROUP", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = K.pack_documents(docs, PATH).collect()
    n = check(rows, [tuple(r) for r in docs.collect()], library, 2048)
    assert n == len(best_fit_decreasing([r["length"] for r in rows], 2048))


def test_edge_cases(spark, library):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "other"), (None, "x"), (5, "word " * 9000), (6, " \n")]
    df = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, length int, salt_ string")
    check(K.pack_documents(df, PATH, 16).collect(), docs, library, 16)
    assert K.pack_documents(df.limit(0), PATH).count() == 0
    kept = K.token_pieces(df, PATH, 2048, keep_ids=True).filter("doc_id = 5").collect()
    assert b"".join(r["ids"] for r in sorted(kept, key=lambda r: r["piece"])) == np.array(library.encode("word " * 9000, add_special_tokens=False).ids + [0], "<u4").tobytes()
