"""SimHash near-duplicates, linked through the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half of its shingle hashes (XXH64, seed 42) have it.
Two fingerprints link at ``max_bits`` or fewer differing bits.  Links are found without comparing all
pairs:

1. Bit statistics: one pass counts how often each pair of bits is set together (a 64 x 64 table).
2. Partitions: correlated bits are grouped into m parts, so that the other parts stay selective.
3. Thresholds: if the thresholds t_i sum to ``max_bits`` - m + 1, every linked pair differs in at most
   t_i bits of some part i (a threshold of -1 leaves a part out).  Dynamic programming picks the t_i
   (and m) with the least estimated cost: signatures emitted plus candidate pairs, which are estimated
   from the bit rates and the number of distinct fingerprints.
4. Probe: in each part a fingerprint emits all keys within ceil(t_i / 2) bits of its own, so any two keys
   at distance t_i or less share a key.  One shuffle brings equal keys together.
5. Verify: the full distance decides.  A group yields links to the fingerprint that a search first
   reached them from, at most one per member, not all pairs.  A key with more than ``HOT`` fingerprints
   is dealt out anew by its remaining bits (the plain pigeonhole: max_bits + 1 blocks); a group that still has
   more is cut into blocks of ``HOT``, and every pair of its blocks is compared by itself.  So at most two
   blocks are compared pairwise.  Keys are counted by partial sums before their fingerprints meet; those with
   more than a fixed share of all (``hot_keys``) never do.

Only distinct fingerprints take part, so exact copies, however many, are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, hot_keys, written
from .components import connected_components

BITS = 64
SEED = 42
HOT = 4096              # fingerprints with one key, from which the key is dealt out anew; size of a block
SHIFTED = 64            # group size up to which all members are compared by shifted vectors
ROW_COST, PAIR_COST = 2e-6, 5e-9   # seconds for a signature row, for a compared pair


# -- fingerprints ---------------------------------------------------------------------------------

def simhash(text: str, shingle: int = 4) -> int:
    """Fingerprint as a signed 64-bit integer; a text without words has fingerprint 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at:at + 65536].tolist(), ends[at:at + 65536].tolist())]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) if t is not None else 0 for t in texts], dtype="int64")
    return fingerprints.asNondeterministic()


# -- partitions and thresholds ----------------------------------------------------------------------

def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both set: at most 64 x 64 rows
    reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            octets = b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(b)
        yield pd.DataFrame({"i": [-1, *np.repeat(np.arange(BITS), BITS)], "j": [-1, *np.tile(np.arange(BITS), BITS)],
                            "n": np.concatenate(([n], total.ravel())).astype(np.int64)})
    rows = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    table, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            table[r["i"], r["j"]] = r["n"]
    return n, table


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each starts with the free bit of the largest total correlation and
    takes the free bits that correlate most with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def within(rates: np.ndarray, t: int) -> float:
    """Probability that two fingerprints differ in at most t bits of a part with these bit rates."""
    dist = np.zeros(t + 2)
    dist[0] = 1.0
    for d in 2 * rates * (1 - rates):
        moved = np.concatenate(([0.0], dist[:-1])) * d
        top = dist[-1]
        dist = dist * (1 - d) + moved
        dist[-1] += top * d
    return float(dist[: t + 1].sum())


def ball(width: int, radius: int) -> np.ndarray:
    """Bit masks of at most ``radius`` of ``width`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return np.array(masks, np.uint64)


def allocate(parts: list[list[int]], rates: np.ndarray, n: int, budget: int) -> tuple[float, list[int]]:
    """Thresholds for the parts that sum to ``budget``, of least estimated cost."""
    def cost(part: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        radius = (t + 1) // 2
        size = sum(_choose(len(part), r) for r in range(radius + 1))
        return n * size * ROW_COST + n * n / 2 * within(rates[part], 2 * radius) * PAIR_COST
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (sofar, chosen) in best.items():
            for t in range(-1, budget + len(parts)):
                total = spent + t
                value = sofar + cost(part, t)
                if total not in after or value < after[total][0]:
                    after[total] = (value, [*chosen, t])
        best = after
    return best[budget]


def _choose(n: int, r: int) -> int:
    out = 1
    for k in range(r):
        out = out * (n - k) // (k + 1)
    return out


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts in use: the cheapest of all numbers of parts."""
    rates = np.diag(both) / max(n, 1)
    options = []
    for m in range(1, max_bits + 2):
        parts = group_bits(both, n, m)
        value, thresholds = allocate(parts, rates, n, max_bits - m + 1)
        options.append((value, m, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


# -- probing and verifying --------------------------------------------------------------------------

def keys_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def star_links(group: np.ndarray, max_bits: int) -> list[tuple[np.uint64, np.ndarray]]:
    """Links that connect what the links of all pairs within the group connect, one per member at most:
    a search takes each fingerprint off the list when it is first reached."""
    out, todo = [], group
    while todo.size > 1:
        front, todo = [todo[0]], todo[1:]
        while front and todo.size:
            at = front.pop()
            near = np.bitwise_count(todo ^ at) <= max_bits
            if near.any():
                found = todo[near]
                todo = todo[~near]
                out.append((at, found))
                front.extend(found)
    return out


def group_links(key: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``key``."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(edge, len(key)))
    left, right = [], []
    for start, size in zip(edge[sizes > SHIFTED], sizes[sizes > SHIFTED]):
        for at, found in star_links(fps[start:start + size], max_bits):
            left.append(np.full(len(found), at, np.uint64))
            right.append(found)
    small = np.repeat(sizes <= SHIFTED, sizes)
    key, fps = key[small], fps[small]
    longest = int(sizes[sizes <= SHIFTED].max(initial=0))
    for d in range(1, longest):
        near = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= max_bits))
        left.append(fps[near])
        right.append(fps[near + d])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def find_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) links between the distinct fingerprints of column ``fp`` that connect all pairs at
    ``max_bits`` or fewer differing bits."""
    n, both = bit_counts(fps)
    parts = plan(n, both, max_bits)
    balls = [ball(len(bits), (t + 1) // 2) for bits, t in parts]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k, (bits, _) in enumerate(parts):
                own = keys_of(x, bits)
                step = max(1, 200_000 // max(1, len(x)))
                for at in range(0, len(balls[k]), step):
                    masks = balls[k][at:at + step]
                    yield pd.DataFrame({"part": np.int32(k), "key": (own[:, None] ^ masks[None, :]).ravel().view(np.int64),
                                        "fp": np.repeat(x, len(masks)).view(np.int64)})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, part = b["fp"].to_numpy(np.int64).view(np.uint64), b["part"].to_numpy()
            for k, (bits, _) in enumerate(parts):
                own = part == k
                rest = [i for i in range(BITS) if i not in bits]
                for s in range(max_bits + 1):
                    if own.any():
                        yield pd.DataFrame({"part": part[own], "key": b["key"].to_numpy()[own], "block": np.int32(s),
                                            "rest": keys_of(x[own], rest[s::max_bits + 1]).view(np.int64), "fp": x[own].view(np.int64)})

    def verify(names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                if not len(b):
                    continue
                ids = (b[names] != b[names].shift()).any(axis=1).cumsum().to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                held = b.iloc[cut:]
                if cut:
                    yield frame(ids[:cut], b["fp"].to_numpy(np.int64)[:cut])
            if held is not None and len(held):
                yield frame(np.zeros(len(held), np.int64), held["fp"].to_numpy(np.int64))

        def frame(ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            a, z = group_links(ids, x.view(np.uint64), max_bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": z.view(np.int64)})
        return run

    def pairs(n: Column) -> Column:
        """The pairs of blocks (low, high) of a group of ``n`` that a fingerprint belongs to."""
        blocks = F.ceil(n / HOT).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        return F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.struct(F.least(own, t).alias("low"), F.greatest(own, t).alias("high")))

    def counted(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows with the size ``n`` of their group, together and in order by group, without those of hot groups; the hot
        groups' rows with theirs)"""
        hot = F.broadcast(hot_keys(rows, names, emitted, HOT).withColumnRenamed("rows_of_key", "n"))
        return rows.join(hot, names, "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*names))), rows.join(hot, names)

    first, second, third = ["part", "key"], ["part", "key", "block", "rest"], ["part", "key", "block", "rest", "low", "high"]
    emitted = n * sum(len(masks) for masks in balls)
    links, small = "a long, b long", F.col("n").between(2, HOT)
    sized, hot = counted(fps.select("fp").mapInPandas(probe, "part int, key long, fp long"), first)
    large = sized.filter(F.col("n") > HOT).select(*first, "fp").unionByName(hot.select(*first, "fp"))
    resized, crowded = counted(large.mapInPandas(again, "part int, key long, block int, rest long, fp long"), second)
    full = resized.filter(F.col("n") > HOT).unionByName(crowded.select(resized.columns)).select(*second, "fp", F.inline(pairs(F.col("n"))))
    return sized.filter(small).select(*first, "fp").mapInPandas(verify(first), links) \
        .union(resized.filter(small).select(*second, "fp").mapInPandas(verify(second), links)) \
        .union(full.repartition(*third).sortWithinPartitions(*third).mapInPandas(verify(third), links))


# -- operators ----------------------------------------------------------------------------------------

def _groups(rows: DataFrame, order: str, max_bits: int) -> DataFrame:
    """(fp, first): the least ``order`` value among all rows whose fingerprints are connected."""
    least = written(rows.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    parts = connected_components(find_links(least, max_bits), "a", "b")
    rooted = least.join(parts, least["fp"] == parts["node"]).select("fp", "root", "first")
    roots = rooted.groupBy("root").agg(F.min("first").alias("group_first"))
    joined = rooted.join(roots, "root").select("fp", "group_first")
    # written, so that both sides of the callers' joins are plain shuffles, which can be split where copies are hot
    return written(least.join(joined, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("first")), "groups")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) per row; component_id is the smallest id reachable through links.

    Null or empty texts, and texts without words, have fingerprint zero and link like any other.  Texts
    of any length are hashed whole.  Repeated rows are kept and share their component.  A null id gives
    a row too, but is never a component's id unless all its members are null.  Extra columns are ignored;
    an empty table gives an empty result."""
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(shingle)(F.col(text_col)).alias("fp")), "simhash")
    out = rows.join(_groups(rows, "id", max_bits), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("first").alias("component_id"))


def simhash_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                        max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id (null ids last, then the
    first in file order, so that repeated rows leave one).  All columns stay as they are."""
    fp, rid = free_name(docs, "fp"), free_name(docs, "row_id")
    rows = written(docs.withColumn(fp, fingerprint_column(shingle)(F.col(text_col)))
                   .withColumn(rid, F.monotonically_increasing_id()), "simhash_rows")
    keyed = rows.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                                                        F.col(rid).alias("row")).alias("place"))
    kept = _groups(keyed, "place", max_bits).select(F.col("first.row").alias(rid)).distinct()
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
