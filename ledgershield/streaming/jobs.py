"""Structured Streaming forms of the gateway and audit operators.

Sources are file streams over the input tables (``readStream`` with the
batch schema and a glob filter); every job runs with
``trigger(availableNow=True)`` so tests and the driver see a finite stream.
Sinks and checkpoints live below the shared ``spark.checkpoint.dir``, so a
restarted driver or a lost executor resumes from the checkpoint instead of
recomputing or double-writing.

* ``stream_redact_route``: stateless: redaction columns + policy routing
  (static policy table) -> parquet sink.
* ``stream_kpi_daily``: calls per UTC day under an event-time watermark: a day is final once the watermark is past
  it and then leaves the state; calls of final days go to corrections, merged on read.
* ``stream_audit_chain``: one chain per log; a table of the logs' last hashes is the state, all logs advance in
  parallel, and a log with most of the calls is linked in bounded buckets.
* ``stream_dedupe``: distinct idempotency keys; the state holds the keys seen within the watermark's delay, older
  rows go to a side table that a batch anti join settles on read.

The stateful jobs keep their state as tables, one folder per batch made from that of the batch before, so that late
rows are kept apart instead of being dropped.  A batch that is run again overwrites its own folder with the same rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import redaction as RD
from ..operators import routing as RT
from ..session import scratch_path
from ..sources import domain as D
from ..sources import files
from ..sources.tables import table


MAX_FILES = 1000          # files that one micro-batch takes


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = MAX_FILES) -> DataFrame:
    """File stream over one input table, a file or a folder of part files (schema taken from the batch scan)."""
    batch = table(spark, sf_dir, name)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", max_files)
    path = f"{sf_dir}/{name}.parquet"
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        # a single file: the source watches folders, so watch its folder for that name
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _run(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
         foreach_batch=None) -> str:
    """Run ``df`` to the end of the available input; return the sink path."""
    spark = df.sparkSession
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    sink, ckpt = os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, sink)).start()
    else:
        q = w.format(fmt).option("path", sink).start()
    q.awaitTermination()
    if q.exception() is not None:  # surface a failed stream
        raise RuntimeError(str(q.exception()))
    return sink


def stream_redact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_stream(spark, sf_dir, "orders")
    reqs = RD.redact_text(D.prompt_requests(spark, sf_dir, orders), "text") \
        .select("request_id", "tenant", "explicit_tier", "stats")
    routed = RT.route(reqs, RT.policies_from_docs(spark, D.policy_catalog()))
    out = routed.select("request_id", "tenant", "tier", "reason", "rule_no", "override_denied", "policy_found",
                        "tier_valid")
    return spark.read.parquet(_run(out, "redact-route"))


class _State:
    """Tables of a stateful job, one folder per batch; only the newest two of the state are kept."""

    def __init__(self, spark: SparkSession, name: str, delay: str = "0 days"):
        self.spark = spark
        self.root = scratch_path(spark, f"stream-{name}-state-{uuid.uuid4().hex}")
        self.delay = delay

    def path(self, table_name: str, batch_id: int | None = None) -> str:
        return os.path.join(self.root, table_name, *([] if batch_id is None else [f"batch_id={batch_id}"]))

    def write(self, df: DataFrame, table_name: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table_name, batch_id))
        return self.spark.read.schema(df.schema).parquet(self.path(table_name, batch_id))

    def read(self, table_name: str, batch_id: int, schema: str) -> DataFrame:
        """The table as batch ``batch_id`` left it; empty before the first batch."""
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table_name, batch_id))

    def read_all(self, table_name: str, schema: str) -> DataFrame:
        if not files.exists(self.spark, self.path(table_name)):
            return self.spark.createDataFrame([], schema)
        columns = self.spark.createDataFrame([], schema).columns           # without the number of the batch
        return self.spark.read.schema(schema).parquet(self.path(table_name)).select(*columns)

    def forget(self, table_name: str, batch_id: int) -> None:
        """Batches before ``batch_id - 1`` cannot be run again: their state goes."""
        files.delete(self.spark, self.path(table_name, batch_id - 2))

    def watermark(self, batch_id: int) -> Column:
        """Newest event time of the batches before ``batch_id`` less the delay (null before the first), as of the marks."""
        newest = self.read("marks", batch_id - 1, "newest timestamp").agg(F.max("newest")).first()[0]
        return F.lit(newest).cast("timestamp") - F.expr(f"interval {self.delay}")

    def mark(self, events: DataFrame, batch_id: int) -> None:
        """Record the newest event time (column ``ts``) so far."""
        so_far = self.read("marks", batch_id - 1, "newest timestamp")
        self.write(so_far.unionByName(events.select(F.max("ts").alias("newest"))).agg(F.max("newest").alias("newest")), "marks", batch_id)


COUNTS = ("calls", "public", "private", "sealed", "entities")
DAYS = "day date, calls long, public long, private long, sealed long, entities long"


class DailyCalls:
    """foreachBatch function: counts per day; open days are the state, final days and corrections are kept."""

    def __init__(self, spark: SparkSession, delay: str):
        self.state = _State(spark, "kpi-daily", delay)

    def __call__(self, batch: DataFrame, batch_id: int, sink: str = "") -> None:
        st = self.state
        total = F.aggregate(F.map_values("redaction_stats"), F.lit(0), lambda a, v: a + v)
        counts = st.write(batch.groupBy(F.to_date("ts").alias("day")).agg(
            F.count(F.lit(1)).alias("calls"), *[F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in ("public", "private", "sealed")],
            F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("entities"), F.max("ts").alias("ts")), "counts", batch_id)
        final_before = F.to_date(st.watermark(batch_id))
        late = F.coalesce(F.col("day") < final_before, F.lit(False))
        st.write(counts.where(late).drop("ts"), "corrections", batch_id)
        st.mark(counts, batch_id)
        is_open = F.coalesce(F.col("day") >= F.to_date(st.watermark(batch_id + 1)), F.lit(True))
        days = st.read("open", batch_id - 1, DAYS).unionByName(counts.where(~late).drop("ts")) \
            .groupBy("day").agg(*[F.sum(c).alias(c) for c in COUNTS])
        st.write(days.where(~is_open), "final", batch_id)
        st.write(days.where(is_open), "open", batch_id)
        for name in ("counts", "open", "marks"):
            st.forget(name, batch_id)
        self.last = batch_id

    def result(self) -> DataFrame:
        """Final and open days with the corrections, one row per day."""
        parts = [self.state.read_all("final", DAYS), self.state.read_all("corrections", DAYS), self.state.read("open", getattr(self, "last", -1), DAYS)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("day").agg(*[F.sum(c).alias(c) for c in COUNTS])


def stream_kpi_daily(spark: SparkSession, sf_dir: str, delay: str = "2 days", max_files: int = MAX_FILES) -> DataFrame:
    """Per UTC day: calls, calls per tier (zero-filled) and entities redacted, complete also for late calls."""
    ev = read_stream(spark, sf_dir, "events", max_files)
    writer = DailyCalls(spark, delay)
    _run(D.audit_calls(spark, sf_dir, ev).withColumn("ts", F.to_timestamp("timestamp")), "kpi-daily", foreach_batch=writer)
    return writer.result()


class ChainWriter:
    """foreachBatch function: link each log's calls to the log's last hash; state: log, last_hash and entries so far."""

    def __init__(self, spark: SparkSession, log: str, bucket_width: int = 1 << 20):
        self.state = _State(spark, "chain")
        self.log, self.width = log, bucket_width
        self.schema = f"{log} string, last_hash string, n long"

    def __call__(self, batch: DataFrame, batch_id: int, sink: str) -> None:
        st, log = self.state, self.log
        before = st.read("last", batch_id - 1, self.schema)
        # within a batch by sequence number, between batches by arrival
        entries = AU.dense_seq(AU.build_entries(batch), [log], "seq", out_col="at", bucket_width=self.width)
        linked = AU.link_chain(entries, [log], "at", last=before, bucket_width=self.width)
        linked = linked.join(before.select(log, "n"), log, "left") \
            .withColumn("seq_in_log", F.col("at") + F.coalesce("n", F.lit(0))).drop("at", "n")
        out = os.path.join(sink, f"batch_id={batch_id}")
        linked.write.mode("overwrite").parquet(out)
        now = batch.sparkSession.read.schema(linked.schema).parquet(out).groupBy(log) \
            .agg(F.max_by("hash", "seq_in_log").alias("last_hash"), (F.max("seq_in_log") + 1).alias("n"))
        st.write(before.unionByName(now).groupBy(log).agg(F.max_by("last_hash", "n").alias("last_hash"), F.max("n").alias("n")), "last", batch_id)
        st.forget("last", batch_id)


def stream_audit_chain(spark: SparkSession, sf_dir: str, max_files: int = MAX_FILES, bucket_width: int = 1 << 20) -> DataFrame:
    """Entries of one chain per tenant, with their place in it."""
    ev = read_stream(spark, sf_dir, "events", max_files)
    sink = _run(D.audit_calls(spark, sf_dir, ev), "audit-chain", foreach_batch=ChainWriter(spark, "tenant", bucket_width))
    return spark.read.parquet(sink).drop("batch_id")


KEYS = "idempotency_key string, ts timestamp"


class Deduplicator:
    """foreachBatch function: keys not seen within the watermark's delay go to ``new``, rows behind it to ``late``."""

    def __init__(self, spark: SparkSession, delay: str):
        self.state = _State(spark, "dedupe", delay)

    def __call__(self, batch: DataFrame, batch_id: int, sink: str = "") -> None:
        st = self.state
        keys = st.write(batch.groupBy("idempotency_key").agg(F.max("ts").alias("ts")), "keys", batch_id)
        late = F.coalesce(F.col("ts") < st.watermark(batch_id), F.lit(False))
        st.write(keys.where(late), "late", batch_id)
        before, fresh = st.read("seen", batch_id - 1, KEYS), keys.where(~late)
        st.write(fresh.join(before, "idempotency_key", "left_anti"), "new", batch_id)
        st.mark(keys, batch_id)
        seen = before.unionByName(fresh).groupBy("idempotency_key").agg(F.max("ts").alias("ts"))
        st.write(seen.where(F.coalesce(F.col("ts") >= st.watermark(batch_id + 1), F.lit(True))), "seen", batch_id)
        for name in ("keys", "seen", "marks"):
            st.forget(name, batch_id)

    def result(self) -> DataFrame:
        """Distinct keys: a key that came back after the delay is in ``new`` twice, and a late one may be new."""
        new = self.state.read_all("new", KEYS).select("idempotency_key").distinct()
        late = self.state.read_all("late", KEYS).select("idempotency_key").distinct()
        return new.unionByName(late.join(new, "idempotency_key", "left_anti"))


def stream_dedupe(spark: SparkSession, sf_dir: str, delay: str = "90 days", max_files: int = MAX_FILES) -> DataFrame:
    """Distinct idempotency keys over the whole stream; proposals without a time are never late."""
    li = read_stream(spark, sf_dir, "lineitem", max_files)
    p = D.ap_proposals(spark, sf_dir, li).where(F.col("idempotency_key").isNotNull()).select("idempotency_key", F.col("proposed_at").alias("ts"))
    writer = Deduplicator(spark, delay)
    _run(p, "dedupe", foreach_batch=writer)
    return writer.result()
