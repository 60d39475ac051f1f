"""Byte-level BPE by backtracking against the library and against merging step by step."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from ledgershield.llm.bpe import Codec, bpe_decode, bpe_encode, read_ranks
from ledgershield.llm.queries import QUERIES

RANKS = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS) as f:
        return Codec(read_ranks(f.read()), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def merged(ranks, piece):
    """Merge the adjacent pair of the lowest rank, the leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def ids(codec, text):
    data = codec.encode(text)
    return [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)]


def test_pieces_of_tokens_and_of_random_bytes(codec, library):
    rnd = random.Random(3)
    tokens = list(codec.ranks)
    for k in range(4000):
        piece = (bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 30))) if k % 3 == 0 else
                 bytes(rnd.choice(b"aeinrst") for _ in range(rnd.randint(1, 40))) if k % 3 == 1 else
                 b"".join(rnd.choice(tokens) for _ in range(rnd.randint(2, 5))))
        assert codec.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)
        if len(piece) < 40:
            assert codec.encode_piece(piece) == merged(codec.ranks, piece)


def test_small_vocabulary_with_a_token_that_merges_do_not_reach():
    """'abc' cannot be merged from 'ab' or 'bc' (neither is a token): only a whole piece gets its id."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"aa": 257, b"aaa": 258, b"ba": 259, b"baa": 260}
    own = Codec(ranks, r"[^ ]+| +")
    assert ids(own, "abc") == [256] and ids(own, "abcd") == [97, 98, 99, 100]
    rnd = random.Random(5)
    for _ in range(3000):
        piece = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 25)))
        assert own.encode_piece(piece) == merged(ranks, piece)


def test_long_pieces_are_linear(codec, library):
    for piece in (b"a" * 60_000, b"ab" * 40_000, b"=-" * 20_000):
        assert codec.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    with open(RANKS) as f:
        own = test_any_text.__dict__.setdefault("own", None) or Codec(read_ranks(f.read()), PATTERN)
    test_any_text.own = own
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert ids(own, text) == library.encode_ordinary(text)


def test_bounded_memory_changes_nothing(codec, library):
    small = Codec(codec.ranks, PATTERN, keep=5)
    text = "Some words, some numbers 12345 and more words: unbelievable! " * 3 + "x" * 100
    assert ids(small, text) == library.encode_ordinary(text)
    assert max(len(small.known), len(small.units)) <= 5 and len(small.compatible) <= 5


def test_rows_of_every_kind(spark, library):
    """Null, empty, repeated and very long texts, null ids, an extra column named like a helper, an empty table."""
    texts = [None, "", "same", "same", "naïve 日本語 🙂\n\n  two", "word " * 30_000]
    df = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    rows = bpe_decode(bpe_encode(df, RANKS, PATTERN), RANKS).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]).decode() for r in rows] == [t or "" for t in texts]
    assert bpe_decode(bpe_encode(df.limit(0), RANKS, PATTERN), RANKS).count() == 0


def test_unknown_ids_are_an_error(spark):
    rows = spark.createDataFrame([([50256],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe_decode(rows, RANKS).collect()


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
