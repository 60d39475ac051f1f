"""Partitioning of narrow scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def widen(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work (regex redaction, hashing) enough tasks.

    A few files arrive in as few partitions (one task per row group), and the regex work would run on
    as few cores.  Input of fewer files than the cluster has cores is dealt out round-robin; more files are
    left alone, so no shuffle is added where the data are large.  The file list comes from the plan: no job
    is started.  Micro-batches are partitioned by their source."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
