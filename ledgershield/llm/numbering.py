"""Dense positions of rows within their groups, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROW = 33          # bits of monotonically_increasing_id() that count within a partition


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part`` and ``at``, their runs): what ``placed`` makes positions of.

    Rows are dealt out by ranges of (group, order), sorted and written, so a large group lies in many partitions;
    nulls come first, equal rows in any order.  A run is the part of a group that lies in one partition: (group,
    part, first, before, total), the rows of the group before it and in all.  There are at most as many runs as
    groups and partitions together.  The group must not be null; the names used here must be free."""
    keys = [group, *order, "tie"]
    rows = written(df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                   .sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), name) \
        .withColumn("part", F.shiftright("at", ROW))
    whole = Window.partitionBy(group)
    runs = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    return rows, runs.select(group, "part", "first", F.sum("many").over(whole).alias("total"), F.coalesce(F.sum("many").over(
        whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def placed(rows: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``pos``, their 0-based place in the group, and the other columns of ``runs`` (as ``total``).

    A row finds its run by group and partition, so no key of the join has more rows than a partition."""
    return rows.join(runs, [group, "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")
