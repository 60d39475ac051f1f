"""Snapshot layer, ingest-run log, audit-log rotation and the CSV statement union."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit as AU
from ..operators import snapshots as SN
from ..session import scratch_path
from ..sources import domain as D
from .audit_queries import ENTRIES_CTE
from .finance_queries import TXN_CTE
from .registry import register

DATASET = "vendor_totals"
SNAP_SCHEMA = T.StructType([
    T.StructField("vendor", T.StringType()), T.StructField("n_invoices", T.LongType()),
    T.StructField("total", T.DecimalType(28, 2)), T.StructField("source", T.StringType()),
])

VQ_CTE = """vd AS (SELECT DISTINCT make_date(year(o_orderdate::DATE), 12, 31) AS as_of FROM orders),
vq AS (
  SELECT 'Vendor ' || (o.o_custkey % 300)::VARCHAR AS vendor, vd.as_of AS snapshot_as_of, count(*) AS n_invoices,
         sum(o.o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS total
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN vd ON o.o_orderdate::DATE <= vd.as_of
  GROUP BY 1, 2),
q2 AS (SELECT * FROM vq WHERE snapshot_as_of = (SELECT max(as_of) FROM vd)),
q1 AS (SELECT * FROM vq WHERE snapshot_as_of = (SELECT as_of FROM vd ORDER BY as_of DESC LIMIT 1 OFFSET 1)),
df AS (SELECT coalesce(q1.vendor, q2.vendor) AS vendor,
              CASE WHEN q1.vendor IS NULL THEN 'added' WHEN q2.vendor IS NULL THEN 'removed'
                   WHEN q1.n_invoices <> q2.n_invoices OR q1.total <> q2.total THEN 'changed' ELSE 'unchanged' END AS change
       FROM q1 FULL OUTER JOIN q2 ON q1.vendor = q2.vendor)"""

DELTA = "vendor string, year int, n_invoices long, total decimal(28,2)"


def vendor_deltas(invoices):
    """Invoices and totals per vendor and year: one pass, whatever the number of versions."""
    return invoices.where(F.col("issue_date").isNotNull()).groupBy("vendor", F.year("issue_date").alias("year")) \
        .agg(F.count(F.lit(1)).alias("n_invoices"), F.sum("amount").cast("decimal(28,2)").alias("total"))


def vendor_versions(deltas, years: list[int]):
    """Totals per vendor up to the end of every year of ``years`` from the vendor's first one on.

    A vendor's years are one short array; each version is the sum of its beginning: no join per version."""
    own = deltas.groupBy("vendor").agg(F.collect_list(F.struct("year", "n_invoices", "total")).alias("d"))
    ends = F.filter(F.array(*[F.lit(y) for y in years]), lambda y: y >= F.array_min(F.col("d.year")))
    rows = own.select("vendor", "d", F.explode(ends).alias("y"))
    part = F.filter("d", lambda x: x["year"] <= F.col("y"))
    return rows.select("vendor", F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["n_invoices"]).alias("n_invoices"),
                       F.aggregate(part, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["total"]).cast("decimal(28,2)")).alias("total"),
                       F.make_date("y", F.lit(12), F.lit(31)).alias("snapshot_as_of"))


def _published(spark, sf_dir, until: int | None = None) -> tuple[str, list[str]]:
    """One version per year end that has invoices, oldest first (up to ``until``): one pass over the invoices."""
    root = scratch_path(spark, f"snapshots-{uuid.uuid4().hex}")
    kept = scratch_path(spark, f"vendor-deltas-{uuid.uuid4().hex}")
    inv = D.invoices(spark, sf_dir)
    vendor_deltas(inv if until is None else inv.where(F.col("issue_date") <= F.make_date(F.lit(until), F.lit(12), F.lit(31)))).write.parquet(kept)
    deltas = spark.read.schema(DELTA).parquet(kept)
    years = sorted(r["year"] for r in deltas.select("year").distinct().collect())
    SN.publish_versions(vendor_versions(deltas, years), root, DATASET, "orders", ["vendor"])
    return root, [f"{y:04d}-12-31" for y in years]


def publish_next(spark, sf_dir, root: str, year: int, attempt: int = 1):
    """The version of one more year: the last version plus that year's invoices; no other invoices are read."""
    last = SN.latest_version(spark, root, DATASET)
    day = F.col("issue_date")
    mine = D.invoices(spark, sf_dir).where((day >= F.lit(f"{year:04d}-01-01").cast("date")) & (day <= F.lit(f"{year:04d}-12-31").cast("date")))
    delta = vendor_deltas(mine).select("vendor", "n_invoices", "total")
    before = SN.scan(spark, root, DATASET, SNAP_SCHEMA).where(F.col("snapshot_as_of") == F.lit(last).cast("date")).select("vendor", "n_invoices", "total")
    rows = before.unionByName(delta).groupBy("vendor").agg(F.sum("n_invoices").alias("n_invoices"), F.sum("total").cast("decimal(28,2)").alias("total"))
    return SN.publish(rows, root, DATASET, f"{year:04d}-12-31", "orders", ["vendor"], attempt)


def _versions(spark, published: tuple[str, list[str]]):
    """The last two versions (an empty older one if there is one only)."""
    root, dates = published
    s = SN.scan(spark, root, DATASET, SNAP_SCHEMA)
    older = s.where(F.col("snapshot_as_of") == F.lit(dates[-2]).cast("date")) if len(dates) > 1 else s.limit(0)
    return older, s.where(F.col("snapshot_as_of") == F.lit(dates[-1]).cast("date"))


@register("snapshot_publish", "2.1", f"""WITH {VQ_CTE}
SELECT '{DATASET}' AS dataset, snapshot_as_of, 'ok' AS status, count(*) AS n_rows FROM vq GROUP BY snapshot_as_of""")
def snapshot_publish(spark, sf_dir):
    root, _ = _published(spark, sf_dir)
    return SN.meta_scan(spark, root, DATASET).select("dataset", "snapshot_as_of", "status", "n_rows")


@register("snapshot_increment", "2.1", f"""WITH {VQ_CTE}
SELECT vendor, n_invoices, total, (SELECT count(*) FROM vd) AS n_versions FROM q2""")
def snapshot_increment(spark, sf_dir):
    """All versions but the newest are published, then the newest from the one before it and its own year:
    the newest version, and the number of versions."""
    newest = D.invoices(spark, sf_dir).agg(F.max(F.year("issue_date"))).first()[0]
    root, _ = _published(spark, sf_dir, until=newest - 1)
    publish_next(spark, sf_dir, root, newest)
    n = SN.meta_scan(spark, root, DATASET).agg(F.count(F.lit(1)).alias("n_versions"))
    s = SN.scan(spark, root, DATASET, SNAP_SCHEMA).where(F.col("snapshot_as_of") == F.lit(f"{newest:04d}-12-31").cast("date"))
    return s.select("vendor", "n_invoices", "total").crossJoin(n)


@register("snapshot_scan", "2.1", f"""WITH {VQ_CTE}
SELECT vendor, snapshot_as_of, n_invoices, total, 'orders' AS source FROM vq""")
def snapshot_scan(spark, sf_dir):
    root, _ = _published(spark, sf_dir)
    return SN.scan(spark, root, DATASET, SNAP_SCHEMA).select("vendor", "snapshot_as_of", "n_invoices", "total",
                                                             "source")


@register("snapshot_meta_scan", "2.1", f"""WITH {VQ_CTE}
SELECT '{DATASET}' AS dataset, snapshot_as_of, 'ok' AS status, 'orders' AS source, count(*) AS n_rows,
       TRUE AS has_bytes, TRUE AS parsed_after_fetch FROM vq GROUP BY snapshot_as_of""")
def snapshot_meta_scan(spark, sf_dir):
    root, _ = _published(spark, sf_dir)
    m = SN.meta_scan(spark, root, DATASET)
    return m.select("dataset", "snapshot_as_of", "status", "source", "n_rows", (F.col("bytes") > 0).alias("has_bytes"),
                    (F.col("parsed_at") >= F.col("fetched_at")).alias("parsed_after_fetch"))


@register("snapshot_archive", "2.1", f"""WITH {VQ_CTE},
r AS (SELECT as_of, dense_rank() OVER (ORDER BY as_of DESC) AS rank FROM vd)
SELECT '{DATASET}' AS dataset, as_of AS snapshot_as_of, rank,
       CASE WHEN rank <= 1 THEN 'current' WHEN rank <= 4 THEN 'history' ELSE 'pruned' END AS place FROM r""")
def snapshot_archive(spark, sf_dir):
    """The newest version stays, three go to history, older ones are deleted."""
    root, _ = _published(spark, sf_dir)
    return SN.archive(spark, root, DATASET, keep=1, keep_history=3).withColumn("rank", F.col("rank").cast("bigint"))


@register("snapshot_diff", "2.1", f"""WITH {VQ_CTE}
SELECT vendor, change FROM df""")
def snapshot_diff(spark, sf_dir):
    old, new = _versions(spark, _published(spark, sf_dir))
    return SN.diff(old, new, ["vendor"])


@register("files_added_removed", "2.9", f"""WITH {VQ_CTE}
SELECT vendor, change FROM df WHERE change IN ('added', 'removed')""")
def files_added_removed(spark, sf_dir):
    old, new = _versions(spark, _published(spark, sf_dir))
    return SN.added_removed(old, new, ["vendor"])


@register("join_snapshot_diff", "2.5", f"""WITH {VQ_CTE}
SELECT change, count(*) AS n FROM df GROUP BY change""")
def join_snapshot_diff(spark, sf_dir):
    old, new = _versions(spark, _published(spark, sf_dir))
    return SN.diff(old, new, ["vendor"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@register("ingest_run_log", "2.1", f"""WITH {VQ_CTE}
SELECT '{DATASET}' AS dataset, (SELECT count(*) FROM vd) AS n_runs, (SELECT count(*) FROM vd) AS n_ok, (SELECT count(*) FROM vq) AS rows_written,
       (SELECT count(*) FROM df WHERE change = 'added') AS last_added,
       (SELECT count(*) FROM df WHERE change = 'changed') AS last_changed,
       (SELECT count(*) FROM df WHERE change = 'removed') AS last_removed""")
def ingest_run_log(spark, sf_dir):
    """Run-level log of the publishes: runs, successes, rows and the file
    changes of the latest run per dataset."""
    runs = SN.run_log(spark, _published(spark, sf_dir)[0])
    return runs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.col("exit_code") == 0, 1)).alias("n_ok"),
        F.sum("n_rows").alias("rows_written"),
        F.max_by("files_added", "snapshot_as_of").alias("last_added"),
        F.max_by("files_changed", "snapshot_as_of").alias("last_changed"),
        F.max_by("files_removed", "snapshot_as_of").alias("last_removed"))


ROTATE_AT = "2024-01-15"


@register("log_rotate", "2.1", f"""WITH {ENTRIES_CTE}
SELECT CASE WHEN timestamp < '{ROTATE_AT}' THEN 1 ELSE 2 END AS version, count(*)::BIGINT AS n_entries,
       TRUE AS ok, NULL::BIGINT AS broken_at
FROM entries GROUP BY 1""")
def log_rotate(spark, sf_dir):
    """The log is rotated at a day boundary: the old log is kept as version 1
    (never overwritten), a fresh chain starts in version 2.  Both read back
    and verify on their own."""
    e = AU.build_entries(D.audit_calls(spark, sf_dir))
    e = e.withColumn("version", F.when(F.col("timestamp") < ROTATE_AT, 1).otherwise(2))
    e = AU.dense_seq(e, ["version"], "seq", out_col="seq_in_log", lay_out=True)
    e = AU.link_chain(e.drop("seq").withColumnRenamed("seq_in_log", "seq"), ["version"])
    path = scratch_path(spark, f"audit-rotate-{uuid.uuid4().hex}")
    AU.write_log(e, path, ["version"])
    lines = AU.scan_log(spark, path, ["version"])
    return AU.verify_chain(lines, ["version"]).select(
        F.col("version").cast("int").alias("version"), "n_entries", "ok", "broken_at")


# Bank exports: two statement formats with different columns.
EXPORT_A = T.StructType([T.StructField(n, t) for n, t in (
    ("booking_date", T.DateType()), ("entity", T.StringType()), ("bank", T.StringType()),
    ("currency", T.StringType()), ("counterparty", T.StringType()), ("direction", T.StringType()),
    ("amount", T.DecimalType(18, 2)))])
EXPORT_B = T.StructType([T.StructField(n, t) for n, t in (
    ("booking_date", T.DateType()), ("entity", T.StringType()), ("bank", T.StringType()),
    ("currency", T.StringType()), ("direction", T.StringType()), ("amount", T.DecimalType(18, 2)),
    ("txn_ref", T.StringType()))])
BANKS_A = ("AMERICA", "EUROPE")
# nulls are written as \N so that a blank counterparty stays an empty string
NULL_TOKEN = "\\N"


@register("statement_union", "2.1", f"""WITH {TXN_CTE}
SELECT CASE WHEN bank IN {BANKS_A} THEN 'export_a' ELSE 'export_b' END AS source, count(*) AS n_txns,
       sum(amount)::DECIMAL(28,2) AS amount, count(*) FILTER (WHERE bank IN {BANKS_A}) AS n_with_counterparty
FROM txn GROUP BY 1""")
def statement_union(spark, sf_dir):
    """Statement CSVs of two banks with different columns, read with explicit
    schemas and unioned by name (missing columns null)."""
    t = D.bank_txns(spark, sf_dir)
    base = scratch_path(spark, f"statements-{uuid.uuid4().hex}")
    a, b = os.path.join(base, "export_a"), os.path.join(base, "export_b")
    t.where(F.col("bank").isin(*BANKS_A)).select(*EXPORT_A.names).write.option("header", True).option("nullValue", NULL_TOKEN).csv(a)
    (t.where(~F.col("bank").isin(*BANKS_A))
     .withColumn("txn_ref", F.concat_ws("-", "bank", F.date_format("booking_date", "yyyyMMdd")))
     .select(*EXPORT_B.names).write.option("header", True).option("nullValue", NULL_TOKEN).csv(b))
    ra = spark.read.schema(EXPORT_A).option("header", True).option("nullValue", NULL_TOKEN).csv(a).withColumn("source", F.lit("export_a"))
    rb = spark.read.schema(EXPORT_B).option("header", True).option("nullValue", NULL_TOKEN).csv(b).withColumn("source", F.lit("export_b"))
    u = ra.unionByName(rb, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n_txns"), F.sum("amount").cast("decimal(28,2)").alias("amount"),
                                   F.count("counterparty").alias("n_with_counterparty"))
