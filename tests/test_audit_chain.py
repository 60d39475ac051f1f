"""Chain verification: tamper each way and compare with a sequential
Python checker written from the reference semantics."""

import hashlib
import json
import os

import pytest

from ledgershield.operators import audit as AU
from ledgershield.sources import domain as D
from pyspark.sql import functions as F


def py_verify(lines):
    """(ok, first broken 0-based index among non-blank lines)."""
    prev = None
    i = 0
    for raw in lines:
        if not raw.strip():
            continue
        try:
            e = json.loads(raw)
        except ValueError:
            return False, i
        body = {k: v for k, v in e.items() if k not in ("hash", "prev_hash")}
        h = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        if e.get("prev_hash") != prev or h != e.get("hash"):
            return False, i
        prev = e.get("hash")
        i += 1
    return True, None


@pytest.fixture(scope="module")
def log_lines(spark, tmp_path_factory):
    calls = D.audit_calls(spark, "/root/testdata/sf0.001").where("seq < 12")
    e = AU.link_chain(AU.build_entries(calls), [])
    path = str(tmp_path_factory.mktemp("log") / "intact")
    AU.write_log(e, path, n_files=3)
    path = os.path.join(path, "batch=0")
    lines = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            with open(os.path.join(path, f)) as fh:
                lines += [x.rstrip("\n") for x in fh]
    return lines


def _spark_verify(spark, tmp_path, lines):
    d = tmp_path / "log"
    d.mkdir()
    (d / "part-00000.txt").write_text("\n".join(lines) + ("\n" if lines else ""))
    r = AU.verify_chain(AU.scan_log(spark, str(d))).collect()[0]
    return r.ok, r.broken_at


def _edit(line, **kv):
    e = json.loads(line)
    e.update(kv)
    return json.dumps(e)


CASES = {
    "intact": lambda ls: ls,
    "field_tampered": lambda ls: ls[:3] + [_edit(ls[3], duration_ms=999999)] + ls[4:],
    "deleted": lambda ls: ls[:4] + ls[5:],
    "swapped": lambda ls: ls[:2] + [ls[3], ls[2]] + ls[4:],
    "corrupt": lambda ls: ls[:5] + ["{not json"] + ls[6:],
    "blank_lines_ignored": lambda ls: ls[:2] + ["", "   "] + ls[2:],
    "first_prev_set": lambda ls: [_edit(ls[0], prev_hash="x")] + ls[1:],
    "empty": lambda ls: [],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_chain_cases(spark, tmp_path, log_lines, case):
    lines = CASES[case](list(log_lines))
    assert py_verify(log_lines) == (True, None)
    assert _spark_verify(spark, tmp_path, lines) == py_verify(lines)


def test_non_ascii_rows_take_the_python_path(spark):
    """Entries with non-ASCII text hash exactly like json.dumps (escaped),
    ASCII entries exactly like the native path: compare both with Python."""
    from pyspark.sql import functions as F
    calls = D.audit_calls(spark, "/root/testdata/sf0.001").where("seq < 8").withColumn(
        "user", F.when(F.col("seq") % 2 == 0, F.lit("Zoë Müller")).otherwise(F.col("user")))
    e = AU.link_chain(AU.build_entries(calls), [])
    rows = e.select("hash", AU.entry_line(e).alias("line")).collect()
    assert len(rows) == 8
    for r in rows:
        obj = json.loads(r.line)
        body = {k: v for k, v in obj.items() if k not in ("hash", "prev_hash")}
        exp = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert r.hash == exp


def test_bounded_buckets_by_default(spark):
    """A window of the numbering and of the linking holds at most 2**16 entries."""
    import inspect
    for f in (AU.dense_seq, AU.link_chain, AU.verify_chain):
        assert inspect.signature(f).parameters["bucket_width"].default <= 1 << 16
    n = (1 << 17) + 5
    e = spark.range(n).select((F.col("id") * 3).alias("seq"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))
    e = AU.dense_seq(e.withColumn("log", F.lit(1)), ["log"], "seq", out_col="at")
    linked = AU.link_chain(e, ["log"], "at")
    bad = linked.where("seq != at * 3 or not (prev_hash <=> if(at = 0, null, concat('h', cast(at - 1 as string))))")
    assert linked.count() == n and bad.count() == 0
