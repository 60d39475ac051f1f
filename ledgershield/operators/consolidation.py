"""Group consolidation: P&L and balance sheet per entity and period,
consolidated totals with an adjustment pseudo-entity, balance checks, the
fiscal-year rollup and the one-row group summary.

Statement lines are long-form rows (entity, period, line, amount DECIMAL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUM = "decimal(28,2)"
CONSOLIDATED = "CONSOLIDATED"
ADJUSTMENT = "ADJUSTMENT"
# P&L lines that make up EBITDA (expenses carry a negative sign).
PL_LINES = ("revenues", "cost_of_goods", "opex")


def pl_consolidation(pl: DataFrame) -> DataFrame:
    """Per (period, line): each entity's amount and the consolidated sum
    (entity = 'CONSOLIDATED'), plus an EBITDA line = revenues + expenses.
    One aggregation with grouping sets over the statement lines."""
    lines = pl.unionByName(
        pl.where(F.col("line").isin(*PL_LINES)).groupBy("entity", "period")
        .agg(F.sum("amount").cast(SUM).alias("amount")).withColumn("line", F.lit("ebitda")))
    g = (lines.groupBy("period", "line").agg(F.sum("amount").cast(SUM).alias("amount"))
         .withColumn("entity", F.lit(CONSOLIDATED)))
    return lines.select("period", "line", "entity", F.col("amount").cast(SUM).alias("amount")).unionByName(g)


def bs_consolidation(bs: DataFrame) -> DataFrame:
    """Per line: each entity, the adjustment pseudo-entity and the
    consolidated amount = sum of entities + adjustment."""
    g = bs.groupBy("line").agg(F.sum("amount").cast(SUM).alias("amount")).withColumn("entity", F.lit(CONSOLIDATED))
    return bs.select("line", "entity", F.col("amount").cast(SUM).alias("amount")).unionByName(g)


def bs_balance_check(bs_cons: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """assets - (liabilities + equity) per entity; reported, not asserted."""
    p = (bs_cons.groupBy("entity").pivot("line", ["assets", "liabilities", "equity"])
         .agg(F.sum("amount")).na.fill(0))
    gap = (F.col("assets") - F.col("liabilities") - F.col("equity")).cast(SUM)
    return p.select("entity", F.col("assets").cast(SUM).alias("assets"),
                    F.col("liabilities").cast(SUM).alias("liabilities"), F.col("equity").cast(SUM).alias("equity"),
                    gap.alias("gap"), (F.abs(gap) <= F.lit(tolerance)).alias("ok"))


def pl_history_rollup(pl: DataFrame) -> DataFrame:
    """Fiscal year = sum of its quarters ('yyyy-Qn' periods), consolidated."""
    year = F.regexp_extract("period", r"^(\d{4})", 1)
    return (pl.groupBy(year.alias("year"), "line")
            .agg(F.sum("amount").cast(SUM).alias("amount"), F.countDistinct("period").alias("n_quarters")))


def group_summary(pl_cons: DataFrame, bs_cons: DataFrame, period: str) -> DataFrame:
    """One record with the consolidated P&L lines of ``period`` and the
    consolidated balance-sheet lines (conditional aggregates, no joins of rows)."""
    p = pl_cons.where((F.col("entity") == CONSOLIDATED) & (F.col("period") == period))
    b = bs_cons.where(F.col("entity") == CONSOLIDATED)
    pv = p.agg(*[F.sum(F.when(F.col("line") == ln, F.col("amount"))).cast(SUM).alias(ln)
                 for ln in PL_LINES + ("ebitda",)])
    bv = b.agg(*[F.sum(F.when(F.col("line") == ln, F.col("amount"))).cast(SUM).alias("total_" + ln)
                 for ln in ("assets", "liabilities", "equity")])
    return pv.join(bv, how="cross").select(F.lit(period).alias("period"), "*")
