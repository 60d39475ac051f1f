import hashlib
import math
import random
import re

from hypothesis import given, settings, strategies as st

from ledgershield.llm import secrets_scan as S

BASE = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))


def slow(text):
    out = sorted((m.start(), o, k, m.end()) for o, (k, p, g, n) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= n)
    return (*(sum(x[2] == k for x in out) for k, *_ in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in out).encode()).hexdigest())


def entropy(w):
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef01", max_size=40), st.integers(2, 8), st.sampled_from([0.5, 1.0, 1.7, 2.2]))
def test_sliding_entropy_against_each_window(s, window, threshold):
    want = set()
    for i in range(len(s) - window + 1):
        if entropy(s[i:i + window]) >= threshold - 1e-9 / window:
            want.update(range(i, i + window))
    got = [p for a, b in S.high_windows(s, window, threshold) for p in range(a, b)]
    assert set(got) == want and len(got) == len(set(got))


def test_base_spans_against_the_stated_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH1234567", "é",
            "K", "xyz/+_.-=", "deadbeef", "\n", "\t", "long_value_here1", "ſ", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "token" + " " * 50_000, "ab12" * 60_000, "AKIA" * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in S.secrets(df).collect():
        t = texts[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == slow(t), (t or "")[:80]
        base = [f"{k}:{s}:{e}" for s, _, k, e in sorted((m.start(), o, k, m.end()) for o, (k, p, g, n) in enumerate(BASE) for m in re.finditer(p, t or "") if len(m[g]) >= n)]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("entropy")] == base
    assert S.secrets(df.limit(0)).count() == 0


def test_table_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = S.secrets(docs).collect()
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == slow(texts[r["doc_id"]]) for r in rows) and len(rows) == len(texts)


def test_entropy_finds_unnamed_keys_and_spares_the_allowed():
    scan = S.Scanner(S.ALLOWED)
    key = "q7Rt9ZpL2mXv8KsW4nYb6HcD"
    text = f"héllo {key} bye"
    assert scan.scan(text)[4] == f"entropy:6:{6 + len(key)}"
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "verylongwordwithoutanydigitsatallinit", "1234567890123456789012345",
                 "aaaaaaaaaaaaaaaaaaaaaaaaa1", "path/to/some/module/file_name/of_2024/thing"):
        assert scan.scan(fine)[4].count("entropy") == 0, fine
    assert "entropy" not in scan.scan(f'token="{key}"')[4]


ALPHABETS = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "small": "abcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}


def test_every_random_key_of_high_entropy_is_found():
    rng, scan = random.Random(8), S.Scanner(S.ALLOWED)
    for name, alphabet in ALPHABETS.items():
        for n in (20, 24, 32, 40):
            keys = [k for k in ("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(500)) if S.high_windows(k, 20, 3.85)]
            hit = sum("entropy" in scan.scan(f"x {k} y")[4] for k in keys)
            assert len(keys) > 50 and hit >= 0.99 * len(keys), (name, n, hit, len(keys))


def test_recall_by_alphabet():
    """Of random keys of 32 characters at least 90 in 100 are found, whatever their alphabet."""
    rng, scan = random.Random(9), S.Scanner(S.ALLOWED)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    found = {}
    for alphabet in (low, up, low + digits, up + digits, up + "234567", low + up, low + up + digits, low + up + digits + "+/", low + up + digits + "_-"):
        keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(300)]
        found[alphabet] = sum("entropy" in scan.scan(f"x {k} y")[4] for k in keys) / len(keys)
    hexadecimal = ["".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(300)]
    found["hex"] = sum("entropy" in scan.scan(f"x {k} y")[4] for k in hexadecimal) / len(hexadecimal)
    assert min(found.values()) >= 0.9, found


def test_class_windows_against_each_window():
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choice("abcdeABCDE0123-/" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(0, 30)))
        thresholds = {k: rng.uniform(1, 3) for k in S.THRESHOLDS}
        want = set()
        for i in range(len(s) - 5):
            w = s[i:i + 6]
            kinds = [n for n, test in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit)) if any(map(test, w))]
            if kinds and kinds != ["digit"] and entropy(w) >= thresholds[", ".join(kinds)] - 1e-9:
                want.update(range(i, i + 6))
        assert {p for a, b in S.class_windows(s, 6, thresholds) for p in range(a, b)} == want


def test_repeated_rows_null_ids_and_own_words(spark):
    key = "q7Rt9ZpL2mXv8KsW4nYb6HcD"
    df = spark.createDataFrame([(None, key), (None, key), (1, "zxqjzxqvkzjxqkzvjxqz")], "doc_id long, text string")
    assert [r["spans"] for r in S.secrets(df.filter("doc_id is null")).collect()] == [f"entropy:0:{len(key)}"] * 2
    assert S.secrets(df.filter("doc_id = 1"), words="zxq jzx qvk zjx qkz vjx xqj xqv kzj xqk zvj xqz " * 9).first()["spans"] == ""


def test_words_are_spared():
    scan = S.Scanner(S.ALLOWED)
    for fine in ("thequickbrownfoxjumpsoverthelazydog", "src/main/resources/application-production.properties", "AbstractConfigurationManagerFactoryBean", "Donaudampfschifffahrtsgesellschaft",
                 "MAXIMUM_NUMBER_OF_CONCURRENT_REQUESTS", "responsabilidades-gubernamentales-nacionales", "read-more-about-this-story-of-the-year-2024"):
        assert "entropy" not in scan.scan(fine)[4], fine


def test_what_base_spans_leave_of_a_key_is_kept():
    scan, key = S.Scanner(S.ALLOWED), "q7Rt9ZpL2mXv8KsW4nYb6HcDgT3xJ5uEaVfQzNwB"
    assert scan.scan(f"AKIA{'B7Q2XK9ZLM4TR8WP'}/{key}")[4] == f"access:0:20,entropy:21:{21 + len(key)}"
    assert scan.scan(f"0f3a9b7c51e2d486-{key}")[4] == f"hex:0:16,entropy:17:{17 + len(key)}"
    assert "entropy" not in scan.scan(f"my_secret={key}")[4]
