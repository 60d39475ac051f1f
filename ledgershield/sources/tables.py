"""Scans of the input tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan.  Column pruning and filter pushdown reach the scan
    because callers only ever select/filter on the returned DataFrame."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)
