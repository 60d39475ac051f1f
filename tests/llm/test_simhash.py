import numpy as np
import pytest
import xxhash

from ledgershield.llm import common
from ledgershield.llm import simhash as S
from ledgershield.llm.components import connected_components


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, max_bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in S.simhash_components(docs).collect()), key=str)
    assert got == slow_components([tuple(r) for r in docs.collect()])


def test_nulls_empty_repeats_and_extra_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, "x"), (3, "", "x"), (4, "  \t\n", None), (None, "A B c d E f", "x"),
            (7, "one", "x"), (8, "ÀÉ b c d 日本", "x"), (9, "w " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in S.simhash_components(df).collect()), key=str)
    assert got == slow_components([(a, b) for a, b, _ in rows])
    kept = S.simhash_deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7, 8, 9]
    empty = df.limit(0)
    assert S.simhash_components(empty).count() == 0 and S.simhash_deduplicate(empty).count() == 0


@pytest.mark.parametrize(("hot", "share"), [(4096, 1000), (20, 1000), (20, 1), (3, 10**9)])
def test_links_connect_what_all_pairs_connect(spark, hot, share, monkeypatch):
    """Also with groups that stay large after the second deal, counted by a window or (every key hot) beforehand."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(common, "SHARE", share)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for c in centres:
        x = int(c)
        for _ in range(150):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                y ^= 1 << int(b)
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    links = [(r["a"], r["b"]) for r in S.find_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]

    def comps(pairs):
        parent = {f: f for f in fps}

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        for a, b in pairs:
            parent[find(a)] = find(b)
        least = {}
        for f in fps:
            least.setdefault(find(f), f)
        return [least[find(f)] for f in fps]
    u = [f & (2**64 - 1) for f in fps]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    assert comps(links) == comps([(fps[i], fps[j]) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4])


def test_every_threshold_plan_is_complete():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    both = bits.T @ bits
    for n in (500, 10**6, 10**10):
        for max_bits in (1, 3, 4):
            parts = S.plan(n, both * n / 500, max_bits)
            assert sum(t + 1 for _, t in parts) == max_bits + 1


@pytest.mark.parametrize("few", [100, 0])
def test_components_of_hubs_and_paths(spark, few, monkeypatch):
    """A hub with most links, as a hot key or not, and a long path."""
    monkeypatch.setattr(common, "FEW", few)
    links = [(5, 1000 + i) for i in range(400)] + [(i, i + 1) for i in range(2000, 2040)] + [(1000, 2000), (7, 8), (9, 9)]
    got = connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    want = {7: 7, 8: 7} | {v: 5 for e in links[:-2] for v in e}
    assert sorted((r["node"], r["root"]) for r in got) == sorted(want.items())
