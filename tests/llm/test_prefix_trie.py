"""Prefix trie against one built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgershield.llm import common
from ledgershield.llm import prefix_trie as T
from ledgershield.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """Turns (role, text) of every conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        convs.setdefault(conv, []).append((turn is not None, turn or 0, key, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in convs.items() if c is not None}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {(): sorted(convs)} if convs else {}
    for c in sorted(convs):
        for d in range(1, len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        x = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += x
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert order(QUERIES["op13_prefix_trie"](spark, sf).collect()) == order(brute(rebuilt(in_order(rows))))


@pytest.mark.parametrize(("chunk", "few"), [(2, 0), (4, 100)])
def test_recursion_over_chunks(spark, monkeypatch, chunk, few):
    """Tiny chunks, so that the recursion is several levels deep; lengths at and beside the borders; common first turns."""
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(T, "BLOCK", 3)
    rnd = random.Random(chunk)
    convs, rows = {}, []
    for c in range(60):
        base = convs[rnd.choice(list(convs))] if convs and rnd.random() < 0.8 else []
        cut = rnd.randint(0, len(base))
        convs[c] = base[:cut] + [("user", rnd.choice(["a", "é", "long text", ""])) for _ in range(rnd.randint(1, 9))]
    convs[61] = [("user", "x")] * 37
    convs[62] = [("user", "x")] * 16 + [("bot", "y")] * 3
    for c, turns in convs.items():
        rows += [(c, 10 * i, role, text) for i, (role, text) in enumerate(turns)]
    rnd.shuffle(rows)
    got = T.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert order(got) == order(brute(in_order(rows)))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, None, "", ""),
            (2, 1, None, "long " * 40_000), (3, 0, "", None), (-4, 0, "", ""), (9, 5, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("seq", "pos", "key", "weight", "size", "total", "name")})
    got = order(T.conversation_trie(df).collect())
    assert got == order(brute(in_order(rows)))
    assert T.conversation_trie(df.limit(0)).count() == 0


def test_rebuilt_conversations_without_turns(spark, tmp_path):
    """Conversation 6 has as many turns as are cut off and no base: it ends at the root."""
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(200)}
    lone = next(c for c in h if c % 5 and h[c] > 1)
    rows = [(lone, i, "user", f"t{i}") for i in range(h[lone] - 1)] + [(lone - lone % 5 + 10, 0, "user", "x"), (lone - lone % 5 + 11, 0, "user", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = order(QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect())
    assert got == order(brute(rebuilt(in_order(rows))))
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)
