import uuid
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgershield.llm import token_shards as S
from ledgershield.llm import tokens as T
from ledgershield.session import scratch_path

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=200), max_size=6), st.floats(0, 1))
def test_image_round_trip(docs, percentile):
    ids = np.array([i for d in docs for i in d], "<u4")
    keys = [None if k == 1 else k * 7 - 9 for k in range(len(docs))]
    image = S.write_image(keys, [len(d) for d in docs], ids, percentile)
    got = S.read_image(image)
    assert got[0] == keys and got[1].tolist() == [len(d) for d in docs] and (got[2] == ids).all()


def test_blocks_are_smaller_than_plain_ids():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(100_000) < 0.01, rng.integers(0, 50_000, 100_000), rng.integers(300, 1300, 100_000)).astype("<u4")
    assert len(S.write_image([1], [100_000], ids)) < 100_000 * 1.6


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    S.write_token_shards(docs.repartition(5), path, PATH)
    got = sorted(tuple(r) for r in S.read_token_shards(spark, path).collect())
    assert got == expected(sorted(tuple(r) for r in docs.collect()))


def test_edge_cases(spark):
    rows = [(None, "null id"), (-5, None), (1, ""), (3, "same"), (3, "same"), (2**40, "é" * 30_000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, part int, image string")
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    S.write_token_shards(df, path, PATH)
    got = sorted((tuple(r) for r in S.read_token_shards(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    S.write_token_shards(df.limit(0), path, PATH)
    assert S.read_token_shards(spark, path).count() == 0


class Counted:
    """A tokenizer that counts the calls it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        def call(*args, **more):
            self.calls += 1
            return getattr(self.tokenizer, name)(*args, **more)
        return call


def test_known_units_ask_the_library_nothing(monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 500)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["Grüße an alle, die da sind.\nNeue Zeile; ende. Zahl 12,5 ", "", " x", ", y", "a  b\t c", "w中 \x05 \x00", "end.", "it's we'll<|endoftext|> ok"] * 40
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for keep in (1_000, 5, 0):
        e = T.Encoder(open(PATH, encoding="utf-8").read(), keep)
        assert list(e.encode(texts)) == want and list(e.encode(texts)) == want and len(e.number) <= max(keep, 3)
    e = T.Encoder(open(PATH, encoding="utf-8").read())
    list(e.encode(texts))
    e.tokenizer = Counted(e.tokenizer)
    plain = [x for x in texts if e._marked(x) is not None]
    assert len(plain) == 200 and len(list(e.encode(plain))) == len(plain) and e.tokenizer.calls == 0
