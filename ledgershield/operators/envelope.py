"""The record of a call that goes back to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import audit as AU


def envelopes(calls: DataFrame, key: str) -> DataFrame:
    """key, envelope (struct) per call.

    ``calls``: key, request_id, tenant, user_name, model, tier, reason, backend, text, redacted_text, response_text, stats,
    n_entities, started_at, duration_ms.  The audit hash is that of the entry which the log gets for the call: it is
    computed from the row, so the record needs no join with the log."""
    entry_of = calls.select(
        F.struct(*calls.columns).alias("call"), F.col(key).alias("seq"),
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), "tenant", F.col("user_name").alias("user"),
        "tier", "model", "request_id", F.col("text").alias("prompt_text"), "response_text",
        F.when(F.col("tier") == "private", F.col("redacted_text")).alias("redacted_prompt_text"), F.col("stats").alias("redaction_stats"),
        "duration_ms", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("gw-host-1").alias("host"))
    e = AU.build_entries(entry_of, keep=("call",))
    call = F.col("call")
    record = F.struct(
        F.col("request_id").alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.col("model"),
        F.array(F.struct(F.lit("text").alias("type"), call["response_text"].alias("text"))).alias("content"),
        F.lit("end_turn").alias("stop_reason"),
        F.struct(F.length(call["text"]).alias("input_chars"), F.length(call["response_text"]).alias("output_chars"),
                 call["n_entities"].alias("entities_redacted")).alias("usage"),
        F.struct(F.col("tier"), call["reason"].alias("tier_reason"), call["backend"].alias("backend"), F.col("tenant"),
                 F.col("redaction_stats").alias("redaction"), F.col("duration_ms"), F.col("hash").alias("audit_hash")).alias("gateway"))
    return e.select(call[key].alias(key), record.alias("envelope"))
