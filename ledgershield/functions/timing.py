"""Arithmetic on stored timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end`` (int, cut off; null if either is null)."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("int")
