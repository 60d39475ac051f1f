"""Token-id shards in patched frame-of-reference blocks.

A shard image (all little-endian) is

    header   4s magic, u4 version, u4 block size, u4 documents, u8 ids, u4 blocks
    docs     i8 id and u1 "id is null" and u4 number of ids, per document
    index    u8 start of each block in the body, and the body's length
    body     per block: u4 minimum, u1 width, u1 exceptions, u2 zero; ``block size`` values less the minimum,
             packed at ``width`` bits; u1 position and then u4 value (less the minimum) of the exceptions

The width of a block is that of its values' ``percentile``; larger values are exceptions.  All blocks of a
shard that have one width are packed and unpacked together by shifts on 64-bit words.

Documents are dealt out by ranges of their id and sorted within each range, so the shards of partition 0,
1, ... follow each other in ascending id order; each Parquet row holds one image of about ``SHARD`` ids
(never a part of a document).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder

HEADER = "<4sIIIQI"
MAGIC, VERSION = b"LSPF", 1
BLOCK = 128
SHARD = 1 << 20
IMAGES = "part int, shard int, n_docs int, n_ids long, image binary"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2**width as rows of bytes."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), BLOCK * width // 8)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    rows = len(packed)
    if not width:
        return np.zeros((rows, BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lane |= words[word + 1] << np.uint64(64 - shift)
        lanes[k] = lane & mask
    return np.ascontiguousarray(lanes.T).reshape(rows, BLOCK)


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.97) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.concatenate((ids, np.full(blocks * BLOCK - n, ids[-1] if n else 0, "<u4"))).reshape(blocks, BLOCK)
    least = padded.min(axis=1) if blocks else np.zeros(0, "<u4")
    rest = padded - least[:, None]
    place = int(percentile * (BLOCK - 1))
    bound = np.partition(rest, place, axis=1)[:, place] if blocks else least
    width = np.frexp(bound.astype(np.float64))[1].astype(np.int64)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    many = over.sum(axis=1)
    starts = np.concatenate(([0], np.cumsum(8 + BLOCK // 8 * width + 5 * many)))
    body = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros(blocks, [("min", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("zero", "<u2")])
    head["min"], head["width"], head["exceptions"] = least, width, many
    body[starts[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body[starts[own, None] + 8 + np.arange(BLOCK // 8 * w)] = pack_bits(np.where(over[own], 0, rest[own]), int(w))
    block, position = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    lists = starts[block] + 8 + BLOCK // 8 * width[block]
    body[lists + rank] = position
    body[(lists + many[block] + 4 * rank)[:, None] + np.arange(4)] = rest[over].astype("<u4").view(np.uint8).reshape(-1, 4)
    keys = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join((struct.pack(HEADER, MAGIC, VERSION, BLOCK, len(doc_ids), n, blocks), keys.tobytes(), null.tobytes(),
                     np.array(lengths, "<u4").tobytes(), starts.astype("<u8").tobytes(), body.tobytes()))


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, numbers of ids, ids)."""
    magic, version, size, docs, n, blocks = struct.unpack_from(HEADER, image)
    if (magic, version, size) != (MAGIC, VERSION, BLOCK):
        raise ValueError("not a shard image of this version")
    at = struct.calcsize(HEADER)
    keys = np.frombuffer(image, "<i8", docs, at)
    null = np.frombuffer(image, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(image, "<u8", blocks + 1, at + 13 * docs).astype(np.int64)
    body = np.frombuffer(image, np.uint8, int(starts[-1]), at + 13 * docs + 8 * (blocks + 1))
    head = body[starts[:-1, None] + np.arange(8)]
    least = head[:, :4].copy().view("<u4")
    width, many = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.empty((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        out[own] = unpack_bits(body[starts[own, None] + 8 + np.arange(BLOCK // 8 * w)], int(w))
    block = np.repeat(np.arange(blocks), many)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    lists = starts[block] + 8 + BLOCK // 8 * width[block]
    out[block, body[lists + rank]] = body[(lists + many[block] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    out += least
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist())], lengths, out.ravel()[:n]


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id",
                       text_col: str = "text", percentile: float = 0.97) -> None:
    """Write the token ids of all documents, each with ``end_id`` after it, in ascending order of id.

    Ids are integers or null (nulls first); rows with equal ids follow each other in the order of their
    texts' hashes.  A null or empty text has the end id alone.  Extra columns are ignored; an empty table
    writes no shards."""
    build, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, shard = build(), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pd.DataFrame:
            nonlocal shard
            ids = np.frombuffer(b"".join(held), "<u4")
            out = pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(keys)], "n_ids": [len(ids)],
                                "image": [write_image(keys, lengths, ids, percentile)]})
            shard += 1
            keys.clear(), lengths.clear(), held.clear()
            return out
        total = 0
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            for key, null, ids in zip(b["id"].fillna(0).astype("int64").tolist(), b["id"].isna().tolist(), tokens.encode(texts)):
                keys.append(None if null else key)
                lengths.append(len(ids) // 4 + 1)
                held += (ids, end)
                total += lengths[-1]
                if total >= SHARD:
                    yield flush()
                    total = 0
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("order"), F.col(text_col).alias("text"))
    rows.repartitionByRange("id", "order").sortWithinPartitions("id", "order").select("id", "text") \
        .mapInPandas(run, IMAGES).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) per document: start counts the ids of all documents before it."""
    images = spark.read.schema(IMAGES).parquet(path)
    schema = "part int, shard int, id long, start_in_shard long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, shard, image in zip(b["part"], b["shard"], b["image"]):
                keys, lengths, ids = read_image(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                data = ids.astype("<u4").tobytes()
                cuts = [data[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = pd.DataFrame({"part": part, "shard": shard, "id": pd.array(keys, "Int64"), "start_in_shard": ends - lengths,
                                    "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(c) for c in cuts]})
                yield out.assign(ids=cuts) if keep_ids else out

    # ids before a shard: the parts before its own (one row per part), then the shards before it within its part
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = images.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("of_shards"))
    found = images.select("part", "shard", "image").mapInPandas(run, schema)
    out = found.join(shards, ["part", "shard"]).join(parts, "part")
    return out.select(F.col("id").alias(id_col), (F.col("of_parts") + F.col("of_shards") + F.col("start_in_shard")).alias("start"),
                      "n_tokens", "ids_crc32", *["ids"] * keep_ids)
