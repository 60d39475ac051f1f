"""Hash-chained audit log as Spark jobs.

* ``build_entries``: hashes of texts and the body hash are row-local.
* ``link_chain``: ``prev_hash`` = recorded hash of the previous entry of the
  same log, by a lag within bounded buckets, so one huge log never runs
  through a single task and gaps in the numbers do not matter.
* ``dense_seq``: distributed zip-with-index per log (bounded row_number
  windows + a small table of bucket offsets).
* ``write_log`` / ``scan_log``: JSON Lines in range-ordered part files; the scan
  numbers non-blank lines in file order without shuffling the lines.
* ``verify_chain``: first broken 0-based index per log.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..plans.joins import widen

BUCKET = "_bucket"          # column of entries that lie in log order: the bucket within the log
LAID_BYTES = 2 << 20        # size of a part of them as the optimizer expects it (some 2**16 entries)


def build_entries(calls: DataFrame, native_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calls -> audit entries (without prev_hash); ``keep`` names further columns to carry.

    calls: seq, timestamp (ISO string), tenant, user, tier, model, request_id,
    prompt_text, response_text, redacted_prompt_text, redaction_stats,
    duration_ms, status, error, host.  Raw texts are hashed and dropped.
    ``response_hash`` is null for a null *or empty* response.
    """
    e = widen(calls).select(
        "seq", "timestamp", "tenant", "user", "tier", "model", "request_id",
        H.sha256_text(F.coalesce(F.col("prompt_text"), F.lit(""))).alias("prompt_hash"),
        F.when(F.col("redacted_prompt_text").isNotNull(), H.sha256_text(F.col("redacted_prompt_text")))
         .alias("redacted_prompt_hash"),
        F.when(F.coalesce(F.col("response_text"), F.lit("")) != "", H.sha256_text(F.col("response_text")))
         .alias("response_hash"),
        H.sorted_map(F.col("redaction_stats")).alias("redaction_stats"),
        F.col("duration_ms").cast("int").alias("duration_ms"),
        "status", "error", "host", *keep)
    native_hash = H.sha256_text(H.body_json())
    if native_only:
        return e.withColumn("hash", native_hash)
    # printable-ASCII rows (the bulk) are hashed in the JVM; only the others
    # reach the one Python UDF (its input is null for the fast rows, so the
    # Arrow batches carry almost nothing).  One projection, one scan.
    safe = F.coalesce(H.ascii_safe(), F.lit(False))
    return e.withColumn("hash", F.coalesce(F.when(safe, native_hash),
                                           H.canonical_hash_udf(F.when(~safe, H.body_json()))))


def link_chain(entries: DataFrame, log_cols: list[str], seq_col: str = "seq", last: DataFrame | None = None,
               bucket_width: int = 1 << 16) -> DataFrame:
    """Add prev_hash: the hash of the entry before in the same log by ``seq_col``, whatever the gaps.

    ``seq_col`` is a unique number per log.  Entries are bucketed by ``seq_col // bucket_width``: a lag runs
    within (log, bucket), so no window holds more than ``bucket_width`` entries, and the first entry of a
    bucket takes the last hash of the bucket before from a (logs x buckets) table.  The first entry of a log
    has null, or ``last_hash`` of ``last`` (log columns, last_hash) when an existing log is extended.

    Entries that lie in log order (``dense_seq``) keep their buckets and their parts: they are not shuffled again."""
    laid = BUCKET in entries.columns
    bkt = BUCKET if laid else "_bkt"
    x = entries if laid else entries.withColumn(bkt, F.floor(F.col(seq_col) / F.lit(bucket_width)).cast("bigint"))
    # of the entries that lie in order the whole last one is taken, so that both sides read the same shuffle
    end = F.max_by(F.struct(*entries.columns), seq_col)["hash"] if laid else F.max_by("hash", seq_col)
    ends = x.groupBy(*log_cols, bkt).agg(end.alias("_end"))
    x = x.withColumn("_in", F.lag("hash").over(Window.partitionBy(*log_cols, bkt).orderBy(seq_col)))
    heads = ends.select(*log_cols, bkt, F.lag("_end").over(Window.partitionBy(*log_cols).orderBy(bkt)).alias("_before"))
    j = x.join(F.broadcast(heads) if laid else heads, [*log_cols, bkt])
    prev = F.coalesce("_in", "_before")
    if last is not None:
        j = j.join(last.select(*log_cols, "last_hash"), log_cols, "left") if log_cols else j.crossJoin(last.select("last_hash"))
        prev = F.coalesce(prev, F.col("last_hash"))
    return j.withColumn("prev_hash", prev).drop("_bkt", "_in", "_before", "last_hash")


def dense_seq(df: DataFrame, log_cols: list[str], order_col: str, out_col: str = "seq",
              bucket_width: int = 1 << 16, lay_out: bool = False) -> DataFrame:
    """0-based dense position of each row within its log, ordered by ``order_col``
    (a unique numeric key).

    Rows are bucketed by ``order_col // bucket_width``; row_number runs per
    (log, bucket), so no window holds more than ``bucket_width`` rows even when
    one log holds a third of the table; bucket offsets come from a small
    (logs x buckets) table.

    ``lay_out`` leaves the rows in log order for ``link_chain`` and ``write_log``: the one shuffle ranges them by
    (log, bucket), the table of offsets is broadcast, and the bucket stays as the column ``BUCKET``.  Rows of one
    key then come by their hash, so that every reading of the shuffle numbers them alike.
    """
    bkt = BUCKET if lay_out else "_bkt"
    x = df.withColumn(bkt, F.floor(F.col(order_col) / F.lit(bucket_width)).cast("bigint"))
    counts = x.groupBy(*log_cols, bkt).agg(F.count(F.lit(1)).alias("_n"))
    if lay_out:
        n = max(df.sparkSession.sparkContext.defaultParallelism, files_for(df, LAID_BYTES))
        x = x.repartitionByRange(n, *log_cols, bkt)
    keys = [order_col, *(["hash"] if lay_out and "hash" in df.columns else [])]
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*log_cols, bkt).orderBy(*keys)) - 1)
    wo = Window.partitionBy(*log_cols).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*log_cols, bkt, F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    out = x.join(F.broadcast(offs) if lay_out else offs, [*log_cols, bkt])
    return out.withColumn(out_col, (F.col("_off") + F.col("_i")).cast("bigint")).drop("_bkt", "_i", "_off")


def entry_line(entries: DataFrame) -> Column:
    """One JSON line per entry, keys sorted, nulls kept."""
    cols = sorted(set(H.ENTRY_FIELDS))
    return F.to_json(F.struct(*[(H.sorted_map(F.col(c)) if c == "redaction_stats" else F.col(c)).alias(c)
                                for c in cols]), {"ignoreNullFields": "false"})


def files_for(df: DataFrame, file_bytes: int) -> int:
    """Number of files for ``df`` from the size that the optimizer expects of it; at least one, at most 2**16."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(1, -(-expected // file_bytes)), 1 << 16)


def write_log(entries: DataFrame, path: str, log_cols: list[str] | None = None,
              seq_col: str = "seq", n_files: int | None = None, batch: int = 0) -> None:
    """Write entries as JSON Lines (see ``write_lines``)."""
    log_cols = log_cols or []
    bucket = [BUCKET] if BUCKET in entries.columns else []
    write_lines(entries.select(*log_cols, *bucket, seq_col, entry_line(entries).alias("value")), path, log_cols, seq_col, n_files, batch)


def lies_in_order(df: DataFrame, log_cols: list[str], seq_col: str) -> bool:
    """Whether the plan itself leaves the rows ranged by (log, bucket) and sorted by number in each part."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    parts = plan.outputPartitioning().toString()
    names = [re.findall(r"(\w+)#\d+L? ASC", x) for x in (parts, plan.outputOrdering().toString())]
    return parts.startswith("rangepartitioning(") and names[0] == [*log_cols, BUCKET] \
        and names[1][:len(log_cols) + 2] == [*log_cols, BUCKET, seq_col]


def write_lines(lines: DataFrame, path: str, log_cols: list[str], seq_col: str = "seq", n_files: int | None = None,
                batch: int = 0, file_bytes: int = 256 << 20, line_bytes: int = 1 << 10) -> None:
    """Write lines (log columns, number, value) range-partitioned by (log, number) and sorted within files, so
    batch number + part number + file number + line order = log order.  One folder per log when ``log_cols`` is
    given (``partitionBy``), and in it one per batch; writing a batch again replaces it, and no other batch is touched.
    Lines that lie in that order already are written as they lie.

    The number of parts follows the input's size, ``file_bytes`` each (one per core at least); where the estimate is
    too low, a part goes on in further files of ``file_bytes // line_bytes`` lines."""
    if n_files is None and BUCKET in lines.columns and lies_in_order(lines, log_cols, seq_col):
        ordered = lines
    else:
        n = n_files or max(lines.sparkSession.sparkContext.defaultParallelism, files_for(lines, file_bytes))
        ordered = lines.repartitionByRange(n, *log_cols, seq_col).sortWithinPartitions(*log_cols, seq_col)
    ordered = ordered.drop(seq_col, BUCKET)
    if log_cols:
        ordered = ordered.withColumn("batch", F.lit(batch))
    writer = ordered.write.mode("overwrite").option("maxRecordsPerFile", max(1, file_bytes // line_bytes))
    if log_cols:
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*log_cols, "batch").text(path)
    else:
        writer.text(f"{path}/batch={batch}")


def last_batch(spark, path: str) -> int:
    """Number of the newest batch of a log, from its file names."""
    numbers = [int(n) for f in spark.read.text(path).inputFiles() for n in re.findall(r"/batch=(\d+)/", f)]
    return max(numbers)


def append_log(entries: DataFrame, path: str, log_cols: list[str] | None = None, seq_col: str = "seq") -> None:
    """Extend an existing log: link ``entries`` (with hash, without prev_hash) to the last entry of each log,
    and write them as the next batch."""
    log_cols = log_cols or []
    spark = entries.sparkSession
    lines = scan_log(spark, path, log_cols)
    last = lines.groupBy(*log_cols).agg(F.max_by("hash", "seq").alias("last_hash")) if log_cols \
        else lines.agg(F.max_by("hash", "seq").alias("last_hash"))
    write_log(link_chain(entries, log_cols, seq_col, last), path, log_cols, seq_col, batch=last_batch(spark, path) + 1)


def scan_log(spark, path: str, log_cols: list[str] | None = None) -> DataFrame:
    """Read a JSON Lines log in file order.

    Blank lines are skipped and not counted.  Output: log columns, seq (0-based
    line index among non-blank lines of the log), raw, corrupt (the line is not a
    JSON object; its text is in raw all the same), and the parsed fields
    ``hash``/``prev_hash``/``tier``/... via ``get_json_object`` (null when the
    line is corrupt).  Numbering uses the split position and a per-task running
    id: no shuffle of the lines, as the table of splits is broadcast (a row per 128 MB or file).
    """
    log_cols = log_cols or []
    base = (spark.read.text(path)
            .where(F.col("value").rlike(r"\S"))
            .select(*log_cols, "value",
                    # numbers, not path text: part-100000 comes after part-99999
                    F.struct(F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).try_cast("bigint").alias("batch"),
                             F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)", 1).try_cast("bigint").alias("part"),
                             F.regexp_extract(F.col("_metadata.file_path"), r"-c(\d+)\.\w+$", 1).try_cast("bigint").alias("file"),
                             F.col("_metadata.file_path").alias("path")).alias("_f"),
                    F.col("_metadata.file_block_start").alias("_b"))
            .withColumn("_m", F.monotonically_increasing_id()))
    splits = base.groupBy(*log_cols, "_f", "_b").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(*log_cols).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = splits.select(*log_cols, "_f", "_b", "_m0", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    j = base.join(F.broadcast(offs), [*log_cols, "_f", "_b"])
    raw = F.col("value")
    parsed = F.try_parse_json(raw)

    def text(name: str) -> Column:
        return F.when(~F.col("corrupt"), F.get_json_object("raw", f"$.{name}")).alias(name)
    x = j.select(
        *log_cols,
        (F.col("_off") + F.col("_m") - F.col("_m0")).cast("bigint").alias("seq"),
        raw.alias("raw"), (parsed.isNull() | ~raw.rlike(r"^\s*\{")).alias("corrupt"))
    return x.select(*log_cols, "seq", "raw", "corrupt", text("hash"), text("prev_hash"), text("tier"),
                    text("tenant").alias("tenant_field"), text("timestamp"), text("status"), text("request_id"))


ENTRY_SCHEMA = ("timestamp string, tenant string, user string, tier string, model string, request_id string, "
                "prompt_hash string, redacted_prompt_hash string, response_hash string, "
                "redaction_stats map<string,int>, duration_ms int, status string, error string, host string, "
                "prev_hash string, hash string")


def recompute_parts(raw: Column) -> tuple[Column, Column]:
    """Canonical body hash of a raw log line: (whether it can be computed natively, that hash).

    Native when the line is printable ASCII and re-serialising its parsed
    form gives back exactly the same bytes (then the parsed struct is a
    faithful copy of the JSON object, and ``to_json`` of its sorted body is
    the canonical form).  Every other line (edited formatting, extra or
    missing fields, non-ASCII, malformed) goes to the Python UDF."""
    p = F.from_json(raw, ENTRY_SCHEMA, {"mode": "PERMISSIVE"})     # the default; without options Spark parses the line once per field
    cols = sorted(set(H.ENTRY_FIELDS))
    reser = F.to_json(F.struct(*[(H.sorted_map(p[c]) if c == "redaction_stats" else p[c]).alias(c) for c in cols]),
                      {"ignoreNullFields": "false"})
    body = F.to_json(F.struct(*[(H.sorted_map(p[c]) if c == "redaction_stats" else p[c]).alias(c)
                                for c in H.BODY_FIELDS]), {"ignoreNullFields": "false"})
    fast = F.coalesce(raw.rlike(H.PRINTABLE_ASCII) & (reser == raw), F.lit(False))
    return fast, H.sha256_text(body)


def verify_chain(lines: DataFrame, log_cols: list[str] | None = None, bucket_width: int = 1 << 16) -> DataFrame:
    """Per log: n_entries, n_broken, broken_at (first broken 0-based index or
    null), ok.  A line is broken if it is malformed, its prev_hash differs from
    the previous line's recorded hash (null for the first line), or its body
    hash does not recompute.

    One shuffle: within (log, bucket) a lag gives the line before, and the same
    partitioning sums each bucket up; the first line of a bucket is judged in
    the (logs x buckets) table against the last hash of the bucket before."""
    log_cols = log_cols or []
    # the fast flag and the native hash are computed once in their own
    # projection (referenced twice, so Catalyst keeps them as columns); only
    # the non-canonical lines reach the Python UDF
    fast, native = recompute_parts(F.col("raw"))
    x = (lines.select(*log_cols, "seq", "hash", "prev_hash", "raw", fast.alias("_fast"), native.alias("_nat"))
         .select(*log_cols, "seq", "hash", "prev_hash",
                 F.coalesce(F.when(F.col("_fast"), F.col("_nat")),
                            H.canonical_hash_udf(F.when(~F.col("_fast"), F.col("raw")))).alias("_re")))
    x = x.select(*log_cols, "seq", "hash", "prev_hash", F.floor(F.col("seq") / bucket_width).alias("_bkt"),
                 (F.col("_re").isNull() | ~F.col("_re").eqNullSafe(F.col("hash"))).alias("_bad"))
    w = Window.partitionBy(*log_cols, "_bkt").orderBy("seq")
    x = x.withColumns({"_before": F.lag("hash").over(w), "_later": F.lag(F.lit(True), 1, False).over(w)})
    broken = F.col("_bad") | (F.col("_later") & ~F.col("prev_hash").eqNullSafe(F.col("_before")))
    buckets = x.groupBy(*log_cols, "_bkt").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(broken, 1)).alias("bad"), F.min(F.when(broken, F.col("seq"))).alias("at"),
        F.min("seq").alias("first"), F.min_by(F.struct("prev_hash", "_bad"), "seq").alias("head"),
        F.max_by(F.struct("hash"), "seq").alias("tail"))
    seam = (~F.col("head.prev_hash").eqNullSafe(F.lag("tail.hash").over(Window.partitionBy(*log_cols).orderBy("_bkt"))) & ~F.col("head._bad"))
    buckets = buckets.withColumn("seam", seam)
    grouped = buckets.groupBy(*log_cols) if log_cols else buckets.groupBy()
    out = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"),
                      F.coalesce(F.sum(F.col("bad") + F.col("seam").cast("int")), F.lit(0)).alias("n_broken"),
                      F.least(F.min("at"), F.min(F.when(F.col("seam"), F.col("first")))).alias("broken_at"))
    return out.withColumn("ok", F.col("broken_at").isNull())


def last_hash(entries: DataFrame, log_cols: list[str], seq_col: str = "seq") -> DataFrame:
    """Hash of the last entry of each log (what the next append links to)."""
    g = entries.groupBy(*log_cols) if log_cols else entries.groupBy()
    return g.agg(F.max_by("hash", seq_col).alias("last_hash"), F.max(seq_col).alias("last_seq"))


def recent(entries: DataFrame, n: int = 100, seq_col: str = "seq") -> DataFrame:
    """Last ``n`` entries, newest first (a top-k: TakeOrderedAndProject)."""
    return entries.orderBy(F.desc(seq_col)).limit(n)


def kpi_by_day(entries: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Per UTC day: calls, public/private/sealed counts (zero-filled), entities redacted."""
    day = F.substring(F.col(ts_col), 1, 10)
    ent = F.aggregate(F.map_values(F.coalesce(F.col("redaction_stats"), F.create_map().cast("map<string,int>"))),
                      F.lit(0), lambda a, v: a + v)
    return (entries.groupBy(day.alias("day"))
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.count(F.when(F.col("tier") == "public", 1)).alias("public"),
                 F.count(F.when(F.col("tier") == "private", 1)).alias("private"),
                 F.count(F.when(F.col("tier") == "sealed", 1)).alias("sealed"),
                 F.sum(ent).cast("bigint").alias("entities")))


def kpi_today(entries: DataFrame, as_of: str, limit: int | None = None, seq_col: str = "seq") -> DataFrame:
    """KPI tiles for one UTC day.  ``limit`` reproduces the dashboard, which
    only looks at the newest ``limit`` entries; None = exact over all rows."""
    src = recent(entries, limit, seq_col) if limit else entries
    k = kpi_by_day(today_filter(src, as_of))
    base = entries.sparkSession.range(1).select(F.lit(as_of).alias("day"))
    return (base.join(k, "day", "left")
            .select("day", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                             for c in ("calls", "public", "private", "sealed", "entities")])
            .withColumn("entities_label", F.concat(F.col("entities").cast("string"),
                                                   F.when(F.col("entities") == 1, F.lit(" entity"))
                                                   .otherwise(F.lit(" entities")), F.lit(" redacted today"))))


def on_day(df: DataFrame, as_of: str, ts_col: str = "ts") -> DataFrame:
    """Rows of one UTC day by a timestamp column: a range, so it prunes files and row groups at the scan."""
    day = F.lit(as_of).cast("date")
    return df.where((F.col(ts_col) >= day.cast("timestamp")) & (F.col(ts_col) < F.date_add(day, 1).cast("timestamp")))


def today_filter(entries: DataFrame, as_of: str, ts_col: str = "timestamp") -> DataFrame:
    """Entries whose timestamp string starts with the UTC date ``as_of``."""
    return entries.where(F.col(ts_col).startswith(as_of))


def row_view(entries: DataFrame) -> DataFrame:
    """Display form of audit rows: time cut to 19 chars, stat chips, short hash."""
    chips = F.array_join(F.transform(F.map_entries(F.coalesce(F.col("redaction_stats"),
                                                              F.create_map().cast("map<string,int>"))),
                                     lambda e: F.concat(e["key"], F.lit(" × "), e["value"].cast("string"))), " ")
    return entries.select(
        "seq",
        F.substring(F.regexp_replace(F.coalesce(F.col("timestamp"), F.lit("")), "T", " "), 1, 19).alias("time"),
        "tenant", "tier", "status",
        F.when(F.col("status") == "ok", "status-ok").otherwise("status-error").alias("status_class"),
        F.when(chips == "", F.lit("none")).otherwise(chips).alias("chips"),
        F.concat(F.col("duration_ms").cast("string"), F.lit(" ms")).alias("duration"),
        F.substring(F.coalesce(F.col("hash"), F.lit("")), 1, 12).alias("hash_short"),
    )
