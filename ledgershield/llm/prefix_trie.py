"""Trie of the prefixes of sequences (conversations and their turns), by van Emde Boas recursion.

Depths are cut at half: of a block of 2w depths the first w form the upper trie, and below every prefix that ends at
the cut hangs a lower trie of w depths.  All upper and lower tries of one size are treated together, so the work takes
a number of rounds that is logarithmic in the depth.

* Names.  The prefix that ends at a cut is named by the name of the prefix that its block starts from and the keys of
  the block's first half; then both halves are cut again.  Equal prefixes, and only they (up to 128 bits of SHA-256),
  get the same name, wherever their sequences are.
* Totals.  Sums over subtrees are known within blocks of one depth; round after round the blocks double: the total of
  every lower trie is grafted onto the cut prefix that it hangs from and onto the prefix's ancestors in the upper trie.
  A prefix is a cut in one round only, and has then as many ancestors to serve as its half block is deep, so a round
  moves no more rows than the sequences have turns.

A row holds ``CHUNK`` turns of a sequence at most; cuts at multiples of CHUNK are made by the same recursion over the
digests of whole chunks.  So no sequence, however long, is held in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .numbering import numbered, placed

CHUNK = 64             # a power of two
NAME = 32              # hexadecimal digits of a name
ROOT = "0" * NAME
BLOCK = 256            # sequence ids that are put into one text for hashing


def name_of(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat(*parts), 256), F.lit(NAME))


def lowest_bit(x: Column) -> Column:
    return x.bitwiseAND(-x)


@dataclass
class Level:
    """Chunks of sequences with the names of their prefixes, and the level of whole chunks above."""
    chunks: DataFrame              # seq, chunk, size, weights, names (from the chunk's start to its end)
    most: int                      # the longest sequence
    above: Level | None


def named(turns: DataFrame, most: int) -> Level:
    """``turns``: seq, pos (from 0, without gaps), key (text), weight, size (of the sequence)."""
    items = F.sort_array(F.collect_list(F.struct("pos", "key", "weight")))
    chunks = turns.groupBy("seq", F.floor(F.col("pos") / CHUNK).alias("chunk"), "size").agg(items.alias("items")) \
        .select("seq", "chunk", "size", F.array_join("items.key", "").alias("keys"), F.size("items").alias("n"),
                F.col("items.weight").alias("weights"), F.length(F.col("items")[0]["key"]).alias("k"))
    above = None
    start, end = F.lit(ROOT), F.lit(None).cast("string")
    if most >= CHUNK:
        chunks = written(chunks, "trie-chunks")
        whole = chunks.filter(F.col("n") == CHUNK).select("seq", F.col("chunk").alias("pos"), name_of(F.col("keys")).alias("key"),
                                                          F.lit(0).cast("long").alias("weight"), F.floor(F.col("size") / CHUNK).alias("size"))
        above = named(whole, most // CHUNK)
        borders = above.chunks.select("seq", F.posexplode("names").alias("i", "name"), (F.col("chunk") * CHUNK).alias("base"))
        # chunk m starts at border m and ends at border m + 1; a chunk of borders repeats the last one of the chunk before
        borders = borders.filter("i > 0").select("seq", (F.col("base") + F.col("i")).alias("border"), "name")
        chunks = chunks.join(borders.select("seq", F.col("border").alias("chunk"), F.col("name").alias("start")), ["seq", "chunk"], "left") \
            .join(borders.select("seq", (F.col("border") - 1).alias("chunk"), F.col("name").alias("end")), ["seq", "chunk"], "left")
        start, end = F.coalesce("start", F.lit(ROOT)), F.col("end")
    cuts = F.array(start)

    def halved(width: int) -> Column:
        """Names at multiples of ``width`` (the column cuts) to names at multiples of its half."""
        half, n, k = width // 2, F.col("n"), F.col("k")
        return F.flatten(F.transform("cuts", lambda name, i: F.array(name, F.when(i * width + half <= n, name_of(
            name, F.substring(F.col("keys"), i * width * k + 1, half * k))))))
    width = CHUNK
    while width > 1:
        chunks = chunks.withColumn("cuts", cuts)
        cuts = halved(width)
        width //= 2
    names = F.array_compact(F.concat(cuts, F.array(end)))
    return Level(written(chunks.select("seq", "chunk", "size", "weights", names.alias("names")), "trie-names"), most, above)


def prefixes(level: Level) -> DataFrame:
    """A row per sequence and prefix: name, parent, depth, weight, seq, size, and ``targets``: the parent's ancestors in
    its half block and the parent itself, which the parent's subtree total is grafted onto (empty at a chunk's start)."""
    def step(r: Column) -> Column:
        p = r - 1
        w = lowest_bit(p)
        return F.struct(F.get("names", r).alias("name"), F.get("names", p).alias("parent"), (F.col("chunk") * CHUNK + r).alias("depth"),
                        F.get("weights", p).alias("weight"),
                        F.when(p > 0, F.array_join(F.slice("names", p - w + 2, w), "")).otherwise("").alias("targets"))
    return level.chunks.select("seq", "size", F.inline(F.transform(F.sequence(F.lit(1), F.size("names") - 1), step)))


def grouped_sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved")])


def subtree_sums(nodes: DataFrame, level: Level) -> DataFrame:
    """(name, leaves, saved) summed over subtrees; ``nodes``: name, parent, targets, depth, leaves, saved, with the root."""
    sums = ("leaves", "saved")
    below = nodes.filter("depth > 0").withColumn("p", (F.col("depth") - 1) % CHUNK)
    grafts: list[DataFrame] = []

    def settled(cut: int) -> DataFrame:
        """The nodes whose parents are cuts of half blocks of ``cut`` depths, with what was grafted onto them."""
        own = below.filter(lowest_bit(F.col("p")) == cut).select("name", "parent", "targets", "p", *sums)
        if not grafts:
            return own
        more = grouped_sums(reduce(DataFrame.unionByName, grafts).filter(F.col("cut") == cut), "name")
        return own.join(more.withColumnsRenamed({c: f"more_{c}" for c in sums}), "name", "left") \
            .select("name", "parent", "targets", "p", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])

    half = 1
    while half < min(CHUNK, level.most):
        trees = grouped_sums(settled(half), "targets", "p")
        # the target at place i lies i + 1 below the block's start; ``cut`` is the lowest bit of its parent's depth
        rows = trees.select("p", *sums, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.substring(
            F.col("targets"), i * NAME + 1, F.lit(NAME)))).alias("i", "name"))
        rows = rows.withColumn("cut", F.when(F.col("i") == 0, lowest_bit(F.col("p") - half)).otherwise(lowest_bit(F.col("i")).cast("long")))
        grafts.append(written(grouped_sums(rows, "name", "cut").select("name", "cut", *sums), "trie-grafts"))
        half *= 2
    total = [nodes.select("name", *sums), *[g.select("name", *sums) for g in grafts]]
    hanging = grouped_sums(settled(0), "parent").withColumnRenamed("parent", "name")      # one chunk below the chunks' starts
    if level.above is None:
        total.append(hanging.select("name", *sums))
    else:
        rows = prefixes(level.above).select("name", "parent", "targets", "depth").distinct()
        root = nodes.filter("depth = 0").select("name", "parent", "targets", "depth")
        starts = rows.unionByName(root).join(hanging, "name", "left").fillna(0, list(sums))
        full = written(subtree_sums(written(starts, "trie-starts"), level.above), "trie-full")
        total.append(full.select("name", *sums))
        inner = level.chunks.filter(F.size("names") == CHUNK + 1).select(F.get("names", F.lit(CHUNK)).alias("name"), F.slice("names", 2, CHUNK - 1).alias("inner"))
        total.append(inner.dropDuplicates(["name"]).join(full, "name").select(F.explode("inner").alias("name"), *sums))
    return grouped_sums(reduce(DataFrame.unionByName, total), "name")


def hash_lists(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the ascending ids (name, seq): blocks of ids are joined by Spark, one digest per name is fed
    with its blocks in order, so a task holds a block at a time however many ids a name has."""
    blocks = ends.groupBy("name", F.floor(F.col("seq") / BLOCK).alias("block")) \
        .agg(F.array_join(F.sort_array(F.collect_list("seq")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            done = []
            for own, ids in zip(b["name"], b["ids"]):
                if own != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["name", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ends_sha256"])
    return blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids").mapInPandas(run, "name string, ends_sha256 string")


def prefix_trie(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences, the empty one (the root) included.

    ``turns``: seq, pos (from 0, without gaps), key (text; all of one length), weight, size; ``seqs``: seq, size (0 for
    sequences without turns).  Result, all long but the last: seq (the smallest member), depth, parent_seq (null for the root),
    n_seqs (members: sequences that start with the prefix), n_children, n_leaves (childless prefixes in its subtree), saved
    (summed over the subtree: members less one, times the weight of the last turn; the root weighs nothing), ends_sha256 (of
    the ascending ids of the sequences that end there, joined by commas).  Without sequences there are no rows."""
    most = seqs.agg(F.max("size")).first()[0]
    if most is None:
        return turns.sparkSession.createDataFrame([], "seq long, depth long, parent_seq long, n_seqs long, n_children long, n_leaves long, saved long, ends_sha256 string")
    level = named(turns, most)
    rows = prefixes(level)
    nodes = rows.groupBy("name", "parent", "targets", "depth", "weight").agg(F.count(F.lit(1)).alias("n_seqs"), F.min("seq").alias("seq"))
    root = seqs.agg(F.count(F.lit(1)).alias("n_seqs"), F.min("seq").alias("seq")).select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("targets"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("weight"), "n_seqs", "seq")
    nodes = written(nodes.unionByName(root), "trie-nodes")
    families = nodes.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(families, "name", "left").fillna(0, ["n_children"]), "trie-families")

    valued = nodes.select("name", "parent", "targets", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
                          ((F.col("n_seqs") - 1) * F.col("weight")).alias("saved"))
    sums = subtree_sums(valued, level)
    last = rows.filter("depth = size").select("name", "seq").unionByName(seqs.filter("size = 0").select(F.lit(ROOT).alias("name"), "seq"))

    # a parent may have most of the prefixes as children
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("seq").alias("parent_seq"))
    origins = spread_join(nodes.filter("depth > 0").select("name", "parent"), parents, "parent", nodes.count()).select("name", "parent_seq")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, "name").join(origins, "name", "left").join(hash_lists(last), "name", "left").select(
        "seq", "depth", "parent_seq", "n_seqs", "n_children", F.col("leaves").alias("n_leaves"), "saved",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


@dataclass
class Conversations:
    """Turns in order, with a digest of role and text as key and the text's bytes as weight."""
    rows: DataFrame
    runs: DataFrame

    def placed(self, runs: DataFrame | None = None) -> DataFrame:
        return placed(self.rows, self.runs if runs is None else runs, "seq")


def read_conversations(conversations: DataFrame, id_col: str = "conv_id") -> Conversations:
    """Null turns come first, equal turn numbers are ordered by the digest of role and text; null role or text is empty.
    Rows without a conversation id belong to no conversation and are left out; extra columns are ignored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("seq"), "turn", name_of(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("key"),
        F.octet_length(text).cast("long").alias("weight"))
    return Conversations(*numbered(rows, "seq", ["turn", "key"], "turns"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``prefix_trie`` of the conversations as they are; repeated rows are turns of their own."""
    c = read_conversations(conversations, id_col)
    seqs = c.runs.select("seq", F.col("total").alias("size")).distinct()
    return prefix_trie(c.placed().withColumnRenamed("total", "size").drop("turn"), seqs)
