"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of 10 consecutive benchmark words (a shorter item is one window).  For each
window length the scan holds

* a shift table: for a block of two adjacent words, how many words the window's end may safely move on
  (blocks that occur in no window move it by almost a whole window);
* suffix buckets: windows by their last block, and within them by their first block;

and confirms each remaining place by comparing the words themselves.  Documents are never shuffled: the
benchmark goes to the documents.  It does so in blocks of at most about ``BLOCK_CHARS`` characters (distinct items by
hash), each with one pass over the documents' texts whose hits are written before the next block is read.  So the
driver and a task hold one block at a time, whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, free_name, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")   # of UTF-8 bytes in lower case: every non-ASCII character is a word character
BLOCK_CHARS = 2_000_000
Window = tuple[bytes, ...]
HIT = "n_words long, spans array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WuManber:
    """Search for windows of one length."""

    def __init__(self, windows: dict[Window, list[int]], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[Window, int] = {}
        self.bucket: dict[Window, dict[Window, list[Window]]] = {}
        self.items = windows
        for w in windows:
            for end in range(self.block, length + 1):
                b = w[end - self.block:end]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.bucket.setdefault(w[-self.block:], {}).setdefault(w[:self.block], []).append(w)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, Window]]:
        """(start, window) of every occurrence, in order of its end."""
        get, far, size, length = self.shift.get, self.far, self.block, self.length
        end, n = length, len(words)
        while end <= n:
            last = tuple(words[end - size:end])
            step = get(last, far)
            if step:
                end += step
                continue
            start = end - length
            for w in self.bucket[last].get(tuple(words[start:start + size]), ()):
                if tuple(words[start:end]) == w:
                    yield start, w
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        by_length: dict[int, dict[Window, list[int]]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            m = min(window, len(words))
            for at in range(len(words) - m + 1 if m else 0):
                owners = by_length.setdefault(m, {}).setdefault(tuple(words[at:at + m]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.searches = [WuManber(w, m) for m, w in sorted(by_length.items())]

    def scan(self, text: str | None, spans: Sequence[int] = (), ids: Sequence[str] = ()) -> tuple[int, list[int], list[str]]:
        """Word count, disjoint hit spans [start, end, ...] in words and item ids, joined with earlier ones."""
        words = words_of(text)
        found, items = list(zip(spans[::2], spans[1::2])), set()
        for s in self.searches:
            for start, w in s.find(words):
                if found and found[-1][0] <= start <= found[-1][1]:
                    found[-1] = (found[-1][0], max(found[-1][1], start + s.length))
                else:
                    found.append((start, start + s.length))
                items.update(s.items[w])
        merged: list[int] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1]:
                merged[-1] = max(merged[-1], b)
            else:
                merged += [a, b]
        return len(words), merged, sorted({*ids, *(self.ids[k] for k in items if self.ids[k] is not None)})


def _search(items: list[tuple[str | None, str]], window: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items, window)
        for texts in batches:
            yield pd.DataFrame([matcher.scan(t) for t in texts], columns=["n_words", "spans", "items"])
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, HIT).asNondeterministic()


def _with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int,
               hit: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")) \
        .filter("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))

    def searched(rows: DataFrame, k: int) -> DataFrame:
        block = [(r["id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]
        return rows.withColumn(hit, _search(block, window)(F.col(text_col)))
    if blocks == 1:
        return searched(docs, 0)
    # one block after the other: its hits are written before the next block is read
    row = free_name(docs, "row_no")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    found = [written(searched(rows.select(row, text_col), k).select(row, f"{hit}.*").filter((F.size("spans") > 0) | (F.lit(k) == 0)), "decontaminate-hits")
             for k in range(blocks)]
    spans = F.array_sort(F.flatten(F.collect_list(F.when(F.size("spans") > 0, _pairs(F.col("spans"))))))
    merged = reduce(DataFrame.unionByName, found).groupBy(row).agg(
        F.max("n_words").alias("n_words"), _disjoint(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(merged.select(row, F.struct("n_words", "spans", "items").alias(hit)), row).drop(row)


def _pairs(spans: Column) -> Column:
    """[start, end, ...] as an array of (a, b)."""
    return F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b")))


def _disjoint(pairs: Column) -> Column:
    """Sorted (a, b) merged where they touch, as [start, end, ...]."""
    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.greatest(last, x["b"])))
        return F.when((F.size(out) > 0) & (x["a"] <= last), joined).otherwise(F.concat(out, F.array(x["a"], x["b"])))
    return F.aggregate(pairs, F.array().cast("array<long>"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted as strings), items_sha256, hit_spans
    (disjoint, [start, end, ...] in words) and contaminated.

    A null or empty text has no words and no hits; a null or wordless item is in no text.  Items with a
    null id mark words but are neither listed nor counted.  Repeated rows give repeated results, repeated
    items count once, and an empty table on either side gives no hits.  Extra columns are ignored."""
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text_of_row"))
    hits = _with_hits(src, benchmark, "text_of_row", item_col, item_text_col, window, "hit_of_row")
    spans = field("hit_of_row", "spans")
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(2)), F.lit(0).cast("long"),
                        lambda acc, k: acc + F.element_at(spans, k + 1) - F.element_at(spans, k))
    n_hit = F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    items = field("hit_of_row", "items")
    return hits.select(id_col, field("hit_of_row", "n_words").alias("n_words"), n_hit.alias("n_hit"),
                       F.size(items).cast("long").alias("n_items"), items.alias("items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), spans.alias("hit_spans"),
                       (F.size(spans) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns as they are."""
    hit = free_name(docs, "hit")
    hits = _with_hits(docs, benchmark, text_col, item_col, item_text_col, window, hit)
    return hits.filter(F.size(field(hit, "spans")) == 0).select(*docs.columns)
