"""Versions, manifests, run log: retries, interrupted steps, increments."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgershield.operators import snapshots as SN
from ledgershield.plans import snapshot_queries as Q
from ledgershield.session import scratch_path
from ledgershield.sources import files

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("source", T.StringType())])


@pytest.fixture
def root(spark):
    return scratch_path(spark, f"test-snapshots-{uuid.uuid4().hex}")


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def content(spark, root, place="current"):
    out = {}
    for r in SN.scan(spark, root, "d", SCHEMA, place).collect():
        out.setdefault(str(r["snapshot_as_of"]), {})[r["k"]] = r["v"]
    return out


def test_republishing_replaces_the_version_and_its_run(spark, root):
    SN.publish(rows(spark, a=1, b=2), root, "d", "2020-12-31", "s", ["k"])
    SN.publish(rows(spark, a=1, c=3), root, "d", "2021-12-31", "s", ["k"])
    for attempt in (1, 1, 2):
        SN.publish(rows(spark, a=5, c=3, d=4), root, "d", "2021-12-31", "s", ["k"], attempt)
    assert content(spark, root) == {"2020-12-31": {"a": 1, "b": 2}, "2021-12-31": {"a": 5, "c": 3, "d": 4}}
    runs = SN.run_log(spark, root).orderBy("snapshot_as_of", "attempt").collect()
    assert [(r["snapshot_as_of"], r["attempt"], r["previous"], r["files_added"], r["files_changed"], r["files_removed"]) for r in runs] == [
        ("2020-12-31", 1, None, 2, 0, 0), ("2021-12-31", 1, "2020-12-31", 2, 1, 1), ("2021-12-31", 2, "2020-12-31", 2, 1, 1)]
    assert [r["n_rows"] for r in SN.meta_scan(spark, root, "d").orderBy("snapshot_as_of").collect()] == [2, 3]


def test_a_run_that_stops_between_two_steps_leaves_a_whole_set(spark, root, monkeypatch):
    for year, v in ((2018, 1), (2019, 2), (2020, 3)):
        SN.publish(rows(spark, a=v), root, "d", f"{year}-12-31", "s", ["k"])
    before = content(spark, root)

    def stop(*_):
        raise RuntimeError("stopped")
    with monkeypatch.context() as m:            # records are written, the manifest is not
        m.setattr(SN.files, "put_once", stop)
        with pytest.raises(RuntimeError):
            SN.publish(rows(spark, a=9), root, "d", "2020-12-31", "s", ["k"])
        with pytest.raises(RuntimeError):
            SN.archive(spark, root, "d", keep=1, keep_history=1)
    assert content(spark, root) == before
    with monkeypatch.context() as m:            # the manifest stands, the clean-up did not run
        m.setattr(SN, "vacuum", stop)
        with pytest.raises(RuntimeError):
            SN.archive(spark, root, "d", keep=1, keep_history=1)
    assert content(spark, root) == {"2020-12-31": {"a": 3}} and content(spark, root, "history") == {"2019-12-31": {"a": 2}}
    SN.vacuum(spark, root, "d")
    assert content(spark, root) == {"2020-12-31": {"a": 3}} and content(spark, root, "history") == {"2019-12-31": {"a": 2}}
    assert sorted(files.names(spark, f"{root}/d/data")) == ["_SUCCESS", "snapshot_as_of=2019-12-31", "snapshot_as_of=2020-12-31"]
    assert len(files.names(spark, f"{root}/d/data/snapshot_as_of=2020-12-31")) == 1


def test_a_manifest_is_never_replaced(spark, root):
    files.put_once(spark, f"{root}/x.json", "one")
    with pytest.raises(FileExistsError):
        files.put_once(spark, f"{root}/x.json", "two")
    assert spark.read.text(f"{root}/x.json").first()[0] == "one" and files.names(spark, root) == ["x.json"]


def test_changes_between_versions_with_gaps(spark):
    df = spark.createDataFrame([("a", 1, "2020-01-01"), ("a", 1, "2020-01-03"), ("b", 1, "2020-01-01"), ("b", 2, "2020-01-02"), ("b", 2, "2020-01-03"),
                                ("c", None, "2020-01-03")], "k string, v long, d string").select("k", "v", F.to_date("d").alias("snapshot_as_of"))
    got = SN.version_changes(df, ["2020-01-01", "2020-01-02", "2020-01-03"], ["k"]).orderBy("snapshot_as_of").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 0, 0), (0, 1, 1), (2, 0, 0)]


def test_a_new_year_reads_that_year_only(spark, monkeypatch):
    root, dates = Q._published(spark, SF, until=1996)
    seen = []
    original = Q.vendor_deltas
    monkeypatch.setattr(Q, "vendor_deltas", lambda inv: (seen.append(inv), original(inv))[1])
    Q.publish_next(spark, SF, root, 1997)
    assert seen[0].agg(F.min(F.year("issue_date")), F.max(F.year("issue_date"))).first()[:] == (1997, 1997)
    assert "PushedFilters: [IsNotNull(o_orderdate)" in seen[0]._jdf.queryExecution().toString()
    assert SN.meta_scan(spark, root, Q.DATASET).count() == len(dates) + 1
