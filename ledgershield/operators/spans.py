"""Redaction from detector spans (the output form of an NER backend).

Input ``spans``: doc_id, start (0-based), end (exclusive), entity_type.  Per document:

1. Overlaps: spans ordered by (start, longest first, type) form clusters: a span that starts before the
   end of any earlier one joins its cluster.  The whole stretch that a cluster covers is redacted, under the
   type of its first span, so no character of any span stays.  (Blind splicing would corrupt the text.)
2. Tokens: '[TYPE_NNNN]', numbered per type by first occurrence; an equal value gets the same token
   again, whatever type a later span gives it.
3. Splice: the pieces between the stretches and the tokens are joined in order.

All windows are partitioned by document, so their size is bounded by one document's spans, never by the
corpus, and the one shuffle by document serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024        # characters


def clusters(spans: DataFrame) -> DataFrame:
    """(doc_id, _sp): each document's redacted stretches (start, end, entity_type), in order."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("_len"), "entity_type")
    s = spans.select("doc_id", "start", "end", "entity_type", (F.col("end") - F.col("start")).alias("_len"))
    s = s.withColumn("_pm", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_no", F.row_number().over(w))
    opens = F.col("_pm").isNull() | (F.col("start") >= F.col("_pm"))
    s = s.withColumn("_c", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = s.groupBy("doc_id", "_c").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("entity_type", "_no").alias("entity_type"))
    return one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type"))).alias("_sp"))


def redact_by_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (doc_id, text) + spans -> doc_id, redacted_text, stats (map type -> distinct values), n_spans
    (redacted stretches).

    A stretch with the text before it becomes one row, and values are numbered by windows over one document's
    rows, so time grows with the text and its spans.  The text is cut once into chunks of ``CHUNK`` characters:
    a substring of the whole would walk over all that comes before it, for every span anew."""
    text = F.col(text_col).cast("string")
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("_doc"),      # ids may repeat
                      F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("_chunks"))
    j = cut.join(clusters(spans), "doc_id", "left")
    # one row per stretch, with the end of the one before, and one for the text after the last
    tail = F.struct(F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit(None).alias("entity_type"))
    rows = F.concat(F.coalesce("_sp", F.array()), F.array(tail))
    befores = F.concat(F.array(F.lit(0)), F.coalesce(F.col("_sp")["end"], F.array()))
    j = j.select("doc_id", "_doc", "_chunks", F.posexplode(F.arrays_zip(rows.alias("sp"), befores.alias("before"))).alias("_no", "_x")) \
        .select("doc_id", "_doc", "_chunks", "_no", F.col("_x.before").alias("_before"), "_x.sp.*")

    def between(start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        some = F.slice("_chunks", first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
        return F.array_join(some, "").substr(start - first * CHUNK + F.lit(1), end - start)
    rest = F.array_join(F.slice("_chunks", F.floor(F.col("_before") / CHUNK).cast("int") + 1, F.greatest(F.size("_chunks"), F.lit(0))), "") \
        .substr(F.col("_before") % CHUNK + F.lit(1), F.lit(2 ** 31 - 1))
    hit = F.col("start").isNotNull()
    j = j.select("doc_id", "_doc", "_no", "entity_type", hit.alias("_hit"), F.when(hit, between(F.col("_before"), F.col("start"))).otherwise(rest).alias("_gap"),
                 F.when(hit, between(F.col("start"), F.col("end"))).alias("_value"))
    # an equal value keeps the type and number of its first stretch
    same = Window.partitionBy("doc_id", "_doc", "_value").orderBy("_no")
    j = j.withColumns({"_first": F.first("_no").over(same), "_kind": F.first("entity_type").over(same)})
    number = F.dense_rank().over(Window.partitionBy("doc_id", "_doc", "_kind").orderBy("_first"))
    token = F.when(F.col("_value").isNotNull(), F.format_string("[%s_%04d]", F.col("_kind"), number)).otherwise(F.lit(""))
    j = j.withColumn("_piece", F.concat("_gap", token))
    one = j.groupBy("doc_id", "_doc").agg(
        F.array_sort(F.collect_list(F.struct("_no", "_piece"))).alias("_pieces"),
        F.collect_list(F.when(F.col("_value").isNotNull() & (F.col("_first") == F.col("_no")), F.col("_kind"))).alias("_types"),
        F.count(F.when(F.col("_hit"), 1)).cast("int").alias("n_spans"), F.count("_gap").alias("_texts"))
    kinds = F.array_sort(F.array_distinct("_types"))
    stats = F.map_from_entries(F.transform(kinds, lambda t: F.struct(t, F.size(F.filter("_types", lambda u: u == t)))))
    return one.select("doc_id", F.when(F.col("_texts") > 0, F.array_join(F.col("_pieces")["_piece"], "")).alias("redacted_text"),
                      stats.alias("stats"), "n_spans")
