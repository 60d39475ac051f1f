"""Flagship plan: corpus -> native redaction -> policy routing -> tier counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DEMO_POLICY
from ..operators import redaction as RD
from ..operators import routing as RT
from ..sources.tables import table


def tier_counts_for_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify every document with the demo tenant policy; count per tier with
    the number of entities redacted (tier, n_docs, n_entities)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    red = RD.redact_text(docs, "text").select(
        "doc_id", F.lit("demo").alias("tenant"), F.lit(None).cast("string").alias("explicit_tier"),
        "stats", "n_entities")
    routed = RT.route(red, RT.policies_from_docs(spark, {"demo": DEMO_POLICY}))
    return (routed.groupBy("tier")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_entities").cast("bigint").alias("n_entities"))
            .orderBy("tier"))
