"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgershield.session import written as written


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def per_text(fn: Callable[[str], tuple], schema: str, setup: Callable[[], object] | None = None) -> Callable[[Column], Column]:
    """A struct column computed from one text column in Arrow batches.

    ``fn(text)`` (or ``fn(state, text)`` when ``setup`` builds a state once per task) returns the
    struct's values.  Only the text goes to Python; the other columns stay in the JVM.  The result is
    marked non-deterministic so that the optimizer never evaluates it twice."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for texts in batches:
            if setup:
                rows = [fn(state, t if t is not None else "") for t in texts]
            else:
                rows = [fn(t if t is not None else "") for t in texts]
            yield pd.DataFrame(dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}, columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()


def field(struct: str, name: str) -> Column:
    return F.col(struct).getField(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SHARE, FEW = 1000, 100      # a key is hot if it has more than one in SHARE of the rows, and more than FEW


def hot_keys(rows: DataFrame, keys: list[str], n: int, few: int | None = None) -> DataFrame:
    """The keys of more than one in SHARE of ``rows`` (``n`` in all), and more than ``few``: fewer than SHARE keys,
    whatever the data, so they may be broadcast.  Counted by partial sums, so no task sees all rows of a key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key")).filter(F.col("rows_of_key") > max(FEW if few is None else few, n // SHARE))


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: int) -> DataFrame:
    """``rows.join(small, key)`` for a ``small`` with one row per key: rows of hot keys get theirs by broadcast, the
    others by a shuffle in which no key has more than its share."""
    hot = hot_keys(rows, [key], n).select(key)
    near = rows.join(F.broadcast(small.join(F.broadcast(hot), key, "left_semi")), key)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(small, key))
