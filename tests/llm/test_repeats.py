import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgershield.llm import repeats as R


def slow(rows, size):
    datas = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(hash(b[i:i + size]) for _, b in datas for i in range(len(b) - size + 1))
    out = []
    for d, b in datas:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[hash(b[i:i + size])] > 1:
                gone[i:i + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, size):
    return sorted((tuple(r) for r in R.remove_repeats(df, size=size).collect()), key=str)


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(0)
    a, b = rng.integers(97, 100, 3000).astype(np.uint8), rng.integers(97, 100, 2000).astype(np.uint8)
    b[500:1200] = a[1000:1700]
    data = np.concatenate((a, b))
    first, windows, at, hashes = R.anchors(data, np.array([0, 3000]), np.array([3000 - 399, 2000 - 399]), 400)
    place = {int(f) + i: (int(p) - int(f) - i, int(h)) for f, n, p, h in zip(first, windows, at, hashes) for i in range(n)}
    assert len(place) == 3000 - 399 + 2000 - 399
    assert all(place[1000 + i] == place[3500 + i] for i in range(301))
    assert all(0 <= s <= 400 - R.GRAM for s, _ in place.values())


@pytest.mark.parametrize("hot,segment", [(20_000, 1 << 20), (1, 150)])
def test_random_texts(spark, monkeypatch, hot, segment):
    for name, value in (("HOT", hot), ("SEGMENT", segment), ("BUFFER", 3000), ("CHUNK", 3)):
        monkeypatch.setattr(R, name, value)
    rng = random.Random(hot)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    texts += [None, "", "z" * 500, "ab" * 400, texts[3], texts[3], "q" * 39, "é" * 20]
    rows = [(i % 85, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n long")
    assert got(df, 40) == slow(rows, 40)
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = slow(rows, 400)
    assert sum(r[2] for r in want) > 0
    assert got(docs, 400) == want
    kept = R.remove_repeats(docs, keep_text=True).first()
    assert hashlib.sha256(kept["kept"]).hexdigest() == kept["kept_sha256"]


def test_planted_passages_are_caught_from_400_bytes_on(spark):
    """A passage of over 50 words that two texts share goes whole where it has 400 bytes, and stays where it is shorter."""
    rng = random.Random(9)

    def words(n, letters):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(n))
    long, short = words(60, 6), words(60, 4)
    assert len(long) >= 400 > len(short) + 2 * 40
    texts = {i: words(100, 5) for i in range(8)}
    texts |= {i: f"{texts[i]}\n{p}\n{words(40, 7)}" for i, p in ((0, long), (1, long), (2, short), (3, short))}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    rows = got(df, 400)
    assert rows == slow(sorted(texts.items()), 400)
    assert all(r[2] >= len(long) and r[3] == 1 for r in rows[:2]) and all(r[2:4] == (0, 0) for r in rows[2:])
