"""Registered queries of the training-data operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgershield.session import scratch_path

from .bpe import bpe_decode, bpe_encode
from .common import table
from .decontaminate import contamination
from .html_extract import main_text
from .imatch import imatch
from .merkle import fold, leaf_digest, manifest, proof_digest
from .packing import pack_documents
from .pii import personal_data
from .prefix_trie import prefix_trie, read_conversations
from .repeats import remove_repeats
from .secrets_scan import secrets
from .simhash import simhash_components
from .token_shards import read_token_shards, write_token_shards
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links at 4 or fewer bits."""
    return simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, max_bits=4)


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), window=10) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
places AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
           FROM d CROSS JOIN (SELECT DISTINCT m FROM win) l, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) t(p)),
hits AS (SELECT doc_id, p, m, item_id FROM places JOIN win USING (m, s)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


VOCABULARY = "byte_bpe_50k.json"


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with an end id each, in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(VOCABULARY), capacity=2048, end_id=0)


@query
def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids with end id 2, written as shards in ascending doc_id order and read back."""
    path = scratch_path(spark, f"token-shards-{uuid.uuid4().hex}")
    write_token_shards(table(spark, sf_dir, "documents", "doc_id", "text"), path, vocabulary_path(VOCABULARY), end_id=2)
    return read_token_shards(spark, path)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are never read by the training."""
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and contextual ones."""
    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans and those of high entropy."""
    return secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return imatch(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of the documents under a 400-byte string that also starts elsewhere, removed."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), size=400)


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


RANKS = "byte_bpe_50k.tiktoken"


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document by rank, and the bytes that they decode to."""
    ranks = vocabulary_path(RANKS)
    rows = bpe_decode(bpe_encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, PATTERN), ranks)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, and the root that it gives once line feeds are deleted from half of them."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf_dir, "documents", *fields)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = leaf_digest(*[F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields])
    changed = F.when(chosen & F.contains("text", F.lit("\n")), F.unhex(cut))
    rows = manifest(docs, fields, carry=[("changed", changed)])
    now = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    rows = rows.withColumn("folded_root", fold(F.col("path"), now))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the rebuilt conversations: up to 8 first turns of each are those of the conversation at c - c % 5."""
    read = read_conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    own = read.runs.select("seq", F.col("total").alias("own")).distinct()
    plan = own.withColumns({"base": F.col("seq") - F.col("seq") % 5, "h": F.crc32(F.col("seq").cast("string").cast("binary")) % 9})
    plan = plan.join(own.select(F.col("seq").alias("base"), F.col("own").alias("of_base")), "base", "left") \
        .withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0)))) \
        .withColumn("size", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    # each row learns its conversation's plan with its place: by conversation and partition
    rows = read.placed(read.runs.join(plan.select("seq", "h", "head", "size"), "seq"))
    kept = rows.filter("pos >= h").select("seq", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "key", "weight", "size")
    first = rows.filter("seq % 5 = 0 and pos < 8").select(F.col("seq").alias("base"), "pos", "key", "weight")
    heads = plan.join(first, "base").filter("pos < head").select("seq", "pos", "key", "weight", "size")
    return prefix_trie(kept.unionByName(heads), plan.select("seq", "size")).select(
        F.col("seq").alias("conv_id"), "depth", F.col("parent_seq").alias("parent_conv_id"), F.col("n_seqs").alias("n_convs"), "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
