"""Removal of long repeated byte strings: every byte covered by a ``size``-byte string that also starts
anywhere else in the corpus.

Every window of ``size`` bytes has an anchor: its least ``GRAM``-byte gram by hash, the leftmost of equal
ones.  The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal places,
and only windows of one anchor gram need comparing.  Windows of one anchor occurrence follow each other
(about half of ``size`` of them); the bytes they span are the occurrence's context.

1. One pass over the texts gives the anchor occurrences with 128-bit hashes of their contexts.
2. Contexts are counted per anchor.  A context that occurs twice repeats whole: copies, however many, end
   here as one row of partial counts per task.
3. Where an anchor has different contexts, one occurrence of each is read again, and the windows themselves
   are compared by hash: contexts of an anchor meet in one task, up to ``HOT`` of them; anchors with more
   are compared by an aggregate over window hashes instead, which no single anchor can overload.
4. Repeated windows become byte ranges of the texts, which are joined and cut out.

Texts are keyed by their MD5, so equal texts are handled once and have equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, written

GRAM = 32
SEGMENT = 1 << 20             # window starts of a long text that are handled at a time
BUFFER = 1 << 20              # bytes of short texts that are handled together
CHUNK, HOT = 2000, 20_000     # contexts compared together; contexts of an anchor from which on an aggregate compares
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
       0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every ``size``-byte gram, built from hashes of 1, 2, 4, ... bytes."""
    level = (data.astype(np.uint64) + np.uint64(0x51)) * np.uint64(ODD[-1])
    level ^= level >> np.uint64(29)
    out, done, width, k = None, 0, 1, 0
    total = len(data) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if size & width:
            part = level[done:done + total]
            out = part.copy() if out is None else (out * np.uint64(ODD[(k + 3) % 9])) ^ (part + (out >> np.uint64(31)))
            done += width
        if width * 2 > size:
            break
        low = level[:-width] * np.uint64(ODD[k % 8])
        low ^= low >> np.uint64(32)
        level = low + level[width:]
        width, k = width * 2, k + 1
    out ^= out >> np.uint64(33)
    out *= np.uint64(ODD[4])
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor position, anchor hash.

    Windows start at ``starts[i]`` to ``starts[i] + counts[i] - 1``; the runs of different i are apart."""
    hashes = gram_hashes(data, GRAM)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    least = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)     # of equal grams the leftmost is least
    span, reach = size - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    window = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    owner = np.repeat(np.arange(len(starts)), counts)
    at = place[window]
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    return window[edge], np.diff(np.append(edge, len(window))), at[edge], hashes[at[edge]]


def _pieces(texts: Iterator[tuple[bytes, bytes]], size: int) -> Iterator[tuple[list[tuple[bytes, int]], np.ndarray, np.ndarray, bytes]]:
    """Texts (key, bytes) gathered to buffers: (key, offset in the text) and window range per piece."""
    owners: list[tuple[bytes, int]] = []
    held: list[bytes] = []
    total = 0
    for key, data in texts:
        for at in range(0, max(0, len(data) - size + 1), SEGMENT):
            part = data[at:at + SEGMENT + size - 1]
            owners.append((key, at))
            held.append(part)
            total += len(part)
            if total >= BUFFER:
                yield _buffer(owners, held, size)
                owners, held, total = [], [], 0
    if held:
        yield _buffer(owners, held, size)


def _buffer(owners, held, size):
    lengths = np.array([len(h) for h in held])
    return owners, np.cumsum(lengths) - lengths, lengths - size + 1, b"".join(held)


OCCURRENCES = "key binary, pos int, windows int, anchor long, lead int, ctx_a long, ctx_b long"


def occurrences_of(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    def texts() -> Iterator[tuple[bytes, bytes]]:
        for b in batches:
            for t in b["text"]:
                data = t.encode("utf-8", "surrogatepass")
                if len(data) >= size:
                    yield hashlib.md5(data).digest(), data
    for owners, starts, counts, data in _pieces(texts(), size):
        first, windows, at, hashes = anchors(np.frombuffer(data, np.uint8), starts, counts, size)
        own = np.searchsorted(starts, first, side="right") - 1
        ends = first + windows + size - 1
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:z], seed=s) for a, z, s in
                                          zip(first.tolist(), ends.tolist(), (at - first).tolist())]), "<i8").reshape(-1, 2)
        yield pd.DataFrame({"key": [owners[i][0] for i in own.tolist()],
                            "pos": (first - starts[own] + np.array([o for _, o in owners])[own]).astype(np.int32), "windows": windows.astype(np.int32),
                            "anchor": hashes.view(np.int64), "lead": (at - first).astype(np.int32), "ctx_a": digests[:, 0], "ctx_b": digests[:, 1]})


def repeated_windows(contexts: list[bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(context, from, to): runs of windows, by number within the context, that other contexts have too."""
    hashes, lengths = [], np.array([len(c) - size + 1 for c in contexts])
    for at in range(0, len(contexts), CHUNK):
        part = contexts[at:at + CHUNK]
        sizes = np.array([len(c) for c in part])
        every = gram_hashes(np.frombuffer(b"".join(part), np.uint8), size)
        starts, counts = np.cumsum(sizes) - sizes, sizes - size + 1
        hashes.append(every[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))])
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(flat), bool)
    twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    owner = np.repeat(np.arange(len(contexts)), lengths)
    number = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hit = np.flatnonzero(twice)
    if len(hit):
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(owner[hit]) != 0))))
        last = np.append(edge[1:], len(hit)) - 1
        yield from zip(owner[hit[edge]].tolist(), number[hit[edge]].tolist(), (number[hit[last]] + 1).tolist())


RANGES = "anchor long, ctx_a long, ctx_b long, first int, last int"


def compare_contexts(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows (anchor, ctx_a, ctx_b, data) sorted by anchor; complete anchors are compared in chunks."""
    held: list[tuple[int, int, int, bytes]] = []

    def flush(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        out = [(*rows[i][:3], a, z) for i, a, z in repeated_windows([r[3] for r in rows], size)]
        return pd.DataFrame(out, columns=["anchor", "ctx_a", "ctx_b", "first", "last"]).astype(
            {"anchor": "int64", "ctx_a": "int64", "ctx_b": "int64", "first": "int32", "last": "int32"})
    for b in batches:
        for row in zip(b["anchor"].tolist(), b["ctx_a"].tolist(), b["ctx_b"].tolist(), b["data"]):
            if len(held) >= CHUNK and held[-1][0] != row[0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def repeated_ranges(docs: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """(key, ranges: array of (start, end)): byte ranges of each distinct text, by MD5, that repeat."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") >= size)
    found = texts.mapInPandas(lambda it: occurrences_of(it, size), OCCURRENCES)
    cols = ["key", "pos", "windows", "anchor", "lead", "ctx_a", "ctx_b"]
    found = written(found.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")), "anchors")
    context = ["anchor", "ctx_a", "ctx_b"]
    contexts = written(found.groupBy(*context).agg(F.sum("n").alias("n"), F.min(F.struct("key", "pos", "windows")).alias("one")), "contexts")
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    unlike = contexts.join(several, "anchor").select(*context, "kinds", "one.*")
    # the bytes of one occurrence of each such context
    wanted = unlike.groupBy("key").agg(F.collect_list(F.struct(*context, "kinds", "pos", "windows")).alias("wanted"))
    keyed = texts.select(F.unhex(F.md5("text")).alias("key"), "text")
    cut_out = keyed.join(wanted, "key").mapInPandas(lambda it: cut_contexts(it, size), CONTEXTS)
    data = written(cut_out.dropDuplicates(context), "context_bytes")
    cold = data.filter(F.col("kinds") <= HOT).select(*context, "data").repartition("anchor").sortWithinPartitions("anchor") \
        .mapInPandas(lambda it: compare_contexts(it, size), RANGES)
    windows = data.filter(F.col("kinds") > HOT).select(*context, "data").mapInPandas(lambda it: windows_of(it, size), WINDOWS)
    # equal windows have one anchor; by both, two different windows can only meet if they share a 32-byte gram
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "window")
    hot = windows.join(twice, ["anchor", "window"]).select(*context, F.col("number").alias("first"), (F.col("number") + 1).alias("last"))
    whole = contexts.filter("n > 1").select(*context, F.lit(0).alias("first"), F.lit(None).cast("int").alias("last"))
    ranges = whole.union(cold).union(hot)
    # where a whole context repeats, its parts say nothing new; both may be there and are joined below
    places = found.select("key", "pos", "windows", *context).join(ranges, context)
    start = F.col("pos") + F.col("first")
    end = F.col("pos") + F.coalesce("last", "windows") + (size - 1)
    return places.groupBy("key").agg(F.collect_set(F.struct(start.alias("s"), end.alias("e"))).alias("ranges"))


CONTEXTS = "anchor long, ctx_a long, ctx_b long, kinds long, data binary"
WINDOWS = "window long, anchor long, ctx_a long, ctx_b long, number int"


def cut_contexts(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted places of each text; of equal texts that follow each other, of the first."""
    names = ["anchor", "ctx_a", "ctx_b", "kinds", "data"]
    rows: list[tuple] = []
    last = None
    for b in batches:
        for key, text, places in zip(b["key"], b["text"], b["wanted"]):
            if key == last:
                continue
            last = key
            data = text.encode("utf-8", "surrogatepass")
            rows += [(p["anchor"], p["ctx_a"], p["ctx_b"], p["kinds"], data[p["pos"]:p["pos"] + p["windows"] + size - 1]) for p in places]
            if len(rows) >= CHUNK:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def windows_of(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """One row per window of each context."""
    for b in batches:
        for anchor, a, z, data in zip(b["anchor"], b["ctx_a"], b["ctx_b"], b["data"]):
            hashes = gram_hashes(np.frombuffer(data, np.uint8), size)
            yield pd.DataFrame({"window": hashes.view(np.int64), "anchor": anchor, "ctx_a": a, "ctx_b": z, "number": np.arange(len(hashes), dtype=np.int32)})


def joined(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges) if ranges is not None else ():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cutter(keep_text: bool):
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            rows = []
            for text, own in zip(texts, ranges):
                data, spans = text.encode("utf-8", "surrogatepass"), joined(own)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)[:4 + keep_text])
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:4 + keep_text])
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, keep_text: bool = False) -> DataFrame:
    """Per document row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, kept].

    Texts are UTF-8 bytes, null counts as empty; matches do not cross texts.  A text shorter than ``size``
    keeps all its bytes.  Repeated rows are copies of each other, so that a repeated long text is removed
    whole from all of them.  Null ids give rows too; extra columns are ignored; an empty table gives an
    empty result."""
    ranges = written(repeated_ranges(docs, text_col, size), "ranges")
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")) \
        .withColumn("key", F.unhex(F.md5("text_")))
    out = rows.join(ranges, "key", "left").select("id_", _cutter(keep_text)(F.col("text_"), F.col("ranges")).alias("cut_"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    return out.select(F.col("id_").alias(id_col), *[field("cut_", c).alias(c) for c in names])
