"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Pieces have at most ``capacity`` different lengths, so best-fit decreasing is decided on the count of
pieces of each length (at most ``capacity`` rows, from one aggregate): pieces of one length, and open bins
of one remaining capacity, are interchangeable.  A segment tree over the remaining capacities finds the
tightest capacity that takes a length in logarithmic time.  The plan is a short list of runs "pieces
number a to b of this length go to bins c to d at this offset"; its size depends on the capacity, not on
the number of documents.  Each piece then looks up its run by its number within its length.  Numbers are
given in salted groups (``GROUP`` pieces on average), so that even a length that a third of all pieces
have is never one task.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import CACHE, encoder

GROUP = 50_000


class Capacities:
    """Segment tree over remaining capacities: how many open bins have each, and the tightest fit."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = self.leaves + remaining
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        at = self.leaves + length
        if at >= 2 * self.leaves:
            return None
        while not self.open[at]:
            while at & 1:          # a right child: nothing further right below this parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, pieces, first bin, offset) of best-fit decreasing: piece ``first + i``
    of that length goes to bin ``first bin + i``.  Bins are numbered from 0."""
    tree = Capacities(capacity)
    ranges: dict[int, deque[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def leave(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            ranges.setdefault(remaining, deque()).append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-(total - done) // (capacity // length))
                bins += n
            else:
                first, n = ranges[room].popleft()
                tree.add(room, -n)
            each = room // length         # a bin is filled up before a looser one takes a piece of this length
            full = min(n, (total - done) // each)
            for k in range(each if full else 0):
                runs.append((length, done, full, first, capacity - room + k * length))
                done += full
            leave(room - each * length, first, full)
            if full < n:
                part = total - done if done < total else 0
                for k in range(part):
                    runs.append((length, done, 1, first + full, capacity - room + k * length))
                    done += 1
                if part:
                    leave(room - part * length, first + full, 1)
                leave(room, first + full + bool(part), n - full - bool(part))
    return runs


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset.  ``order`` names columns that tell pieces apart; pieces that
    agree in all of them may swap places.  Lengths run from 1 to ``capacity``.  ``pieces`` is read three
    times, so it should be a written table."""
    counts = {r[length_col]: r["n"] for r in pieces.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not n or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    runs = np.array(sorted(plan_bins(counts, capacity)), np.int64).reshape(-1, 5)
    at = runs[:, 0] << 48 | runs[:, 1]
    salts = max(1, sum(counts.values()) // GROUP)
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(F.col(length_col), "salt_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(length_col).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length_col, "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy(length_col, "salt_").orderBy(*order)) - 1
    numbered = salted.withColumn("number_", within).join(bases, [length_col, "salt_"]) \
        .withColumn("number_", F.col("number_") + F.col("base_"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, numbers in batches:
            number = numbers.to_numpy(np.int64)
            k = np.searchsorted(at, lengths.to_numpy(np.int64) << 48 | number, side="right") - 1
            yield pd.DataFrame({"sequence_id": runs[k, 3] + number - runs[k, 1], "offset": runs[k, 4]})

    placed = numbered.withColumn("place_", place.asNondeterministic()(F.col(length_col).cast("long"), "number_"))
    return placed.select(*pieces.columns, F.col("place_.sequence_id").alias("sequence_id"), F.col("place_.offset").alias("offset"))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False, keep_units: int = CACHE) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece: the document's token ids and ``end_id``, cut
    into pieces of ``capacity`` of which the first may be shorter.  ids are little-endian 32-bit.
    ``keep_units`` bounds what a Python worker remembers (about 230 bytes a unit)."""
    build, end = encoder(vocabulary, keep_units), np.array([end_id], "<u4").tobytes()
    schema = f"{_type(docs, id_col)}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, rows = build(), []
        for b in batches:
            for key, ids in zip(b["id"], tokens.encode([t if t is not None else "" for t in b["text"]])):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, (a, z) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    part = ids[4 * a:4 * z]
                    rows.append((key, piece, a, z - a, zlib.crc32(part), part)[:5 + keep_ids])
                    if len(rows) >= 5000:
                        yield _frame(rows, keep_ids)
                        rows = []
        yield _frame(rows, keep_ids)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def _frame(rows: list[tuple], keep_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"][:5 + keep_ids], dtype=object)
    return out.astype({"piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})


def _type(docs: DataFrame, id_col: str) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}"


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False, keep_units: int = CACHE) -> DataFrame:
    """One row per piece of every document row: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone.  Texts of any length are cut, never shortened.  Repeated
    rows and equal or null ids are packed row by row; extra columns are ignored; an empty table gives an
    empty result.  Sequence numbers start at 0 and every sequence is filled from offset 0 without gaps."""
    pieces = written(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids, keep_units), "pieces")
    return pack(pieces, capacity, [id_col, "piece", "start", "length", "ids_crc32"])
