"""Detection, redaction and rehydration jobs over text tables.

All row-level work is native Spark expressions (see ``functions.redact``);
the only shuffles are the per-request / per-type aggregations, which are
partial (map-side) aggregations, so a hot request or type cannot pile up in
one task before the combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact as R
from ..functions.patterns import DETECTORS, Detector
from .spans import redact_by_spans

REGEX, SPANS = "regex", "spans"


def detector(entity: str) -> Detector:
    for d in DETECTORS:
        if d.entity == entity:
            return d
    raise KeyError(entity)


def detect_entities(df: DataFrame, id_cols: list[str], text_col: str, entity: str) -> DataFrame:
    """Rows with at least one match of one detector on the *original* text:
    ids, n_hits, n_distinct, hits (joined by '|', in text order)."""
    hits = R.detect(F.coalesce(F.col(text_col), F.lit("")), detector(entity))
    return (df.select(*id_cols, hits.alias("_h"))
            .where(F.size("_h") > 0)
            .select(*id_cols,
                    F.size("_h").cast("bigint").alias("n_hits"),
                    F.size(F.array_distinct("_h")).cast("bigint").alias("n_distinct"),
                    F.array_join("_h", "|").alias("hits")))


def redact_text(df: DataFrame, text_col: str, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Input columns + redacted_text, tokens, stats, n_entities, n_<type>, backend.  ``detectors`` apply in order; own
    ones may be added (``DETECTORS + (Detector(...),)``)."""
    return R.redact(df, text_col, detectors).withColumn("backend", F.lit(REGEX))


def redact_documents(docs: DataFrame, spans: DataFrame | None = None, prefer: str | None = None,
                     detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, redacted_text, stats, backend.

    With the spans of a detector the span path is taken, without them the patterns; ``prefer="regex"`` forces the
    patterns, ``prefer="spans"`` is an error without spans."""
    if prefer not in (None, REGEX, SPANS) or prefer == SPANS and spans is None:
        raise ValueError(f"no backend {prefer!r} here")
    if spans is None or prefer == REGEX:
        return redact_text(docs.select("doc_id", "text"), "text", detectors).select("doc_id", "redacted_text", "stats", "backend")
    return redact_by_spans(docs, spans).select("doc_id", "redacted_text", "stats", F.lit(SPANS).alias("backend"))


def stats_long(redacted: DataFrame, id_cols: list[str]) -> DataFrame:
    """Stats map as rows: ids, entity, n (types with zero count are absent)."""
    return redacted.select(*id_cols, F.explode("stats").alias("entity", "n")) \
        .select(*id_cols, "entity", F.col("n").cast("bigint").alias("n"))


def tokens_long(redacted: DataFrame, id_cols: list[str]) -> DataFrame:
    """Rehydration map as rows: ids, token, value, entity (restricted output)."""
    return redacted.select(*id_cols, F.explode("tokens").alias("t")) \
        .select(*id_cols, F.col("t.token").alias("token"), F.col("t.value").alias("value"),
                F.col("t.entity").alias("entity"))


def rehydrate(responses: DataFrame, tokens: DataFrame, key: str | list[str], text_col: str = "text") -> DataFrame:
    """Put original values back into response texts.

    ``tokens`` is a long table (key, token, value).  The token list of a key is
    gathered next to its response with one equi-join on ``key``; a key's token
    list is bounded by the size of its own prompt.
    """
    key = [key] if isinstance(key, str) else list(key)
    per_key = tokens.groupBy(*key).agg(
        F.collect_list(F.struct(F.col("token"), F.col("value"), F.lit(None).cast("string").alias("entity")))
        .alias("_toks"))
    j = responses.join(per_key, key, "left")
    return j.select(*[c for c in responses.columns if c != text_col],
                    R.rehydrate_expr(F.col(text_col), F.coalesce(F.col("_toks"), F.array().cast(R.TOKENS_TYPE)))
                    .alias(text_col))


def entity_corpus_stats(redacted: DataFrame) -> DataFrame:
    """Per entity type: texts containing it and distinct values summed over texts."""
    ex = redacted.select(F.explode("stats").alias("entity", "n"))
    return ex.groupBy("entity").agg(F.count(F.lit(1)).alias("n_texts"),
                                    F.sum("n").cast("bigint").alias("n_values"))


Key = str | list[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def redact_messages(messages: DataFrame, key: Key = "request_id", order_col: str = "turn",
                    text_col: str = "text") -> DataFrame:
    """Redact every message separately (tokens restart per message, as in the
    multi-message tier).  Returns per message: key, order, redacted_text, tokens,
    stats, n_entities, n_<type>.  ``key`` must identify a request: a short request
    id is a label, give the column that it comes from with it."""
    return R.redact(messages.select(*_keys(key), order_col, text_col), text_col)


def merged_stats(redacted_msgs: DataFrame, key: Key = "request_id") -> DataFrame:
    """Stats added over the messages of a request: key, entity, n."""
    return (redacted_msgs.select(*_keys(key), F.explode("stats").alias("entity", "n"))
            .groupBy(*_keys(key), "entity").agg(F.sum("n").cast("bigint").alias("n")))


def merged_rehydration(redacted_msgs: DataFrame, key: Key = "request_id", order_col: str = "turn") -> DataFrame:
    """Per-request token map merged over messages, *first message wins* when
    two messages produced the same token (reference behaviour; see
    ``request_token_map`` for the collision-free numbering)."""
    ex = redacted_msgs.select(*_keys(key), order_col, F.explode("tokens").alias("t"))
    return (ex.groupBy(*_keys(key), F.col("t.token").alias("token"))
            .agg(F.min_by(F.col("t.value"), F.col(order_col)).alias("value")))


def request_token_map(redacted_msgs: DataFrame, key: Key = "request_id", order_col: str = "turn") -> DataFrame:
    """Collision-free token map per request (deliberate fix): distinct values are
    numbered per (request, type) by first occurrence over all messages.

    The window is partitioned by (request, type); its size is the number of
    distinct sensitive values in one request, bounded by the prompt size.
    """
    ex = redacted_msgs.select(*_keys(key), order_col, F.posexplode("tokens").alias("pos", "t"))
    first = (ex.groupBy(*_keys(key), F.col("t.entity").alias("entity"), F.col("t.value").alias("value"))
             .agg(F.min(F.struct(F.col(order_col), F.col("pos"))).alias("first")))
    w = Window.partitionBy(*_keys(key), "entity").orderBy("first")
    return first.select(*_keys(key), "entity", "value",
                        F.format_string("[%s_%04d]", F.col("entity"), F.row_number().over(w)).alias("token"))
