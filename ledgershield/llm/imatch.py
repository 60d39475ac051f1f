"""Document fingerprints by I-Match over randomised lexicon subsets, as DataFrame expressions.

1. Lexicon: the number of documents with each term is counted over all documents; terms within a band of
   inverse document frequency stay.  The band's rare end is moved so that the lexicon has at most
   ``LEXICON`` terms, which bounds what is broadcast, whatever the corpus.
2. A document's distinct lexicon terms are dealt to ``SUBSETS`` random subsets of the lexicon; each subset's
   terms are sorted and hashed.  An edit changes the hashes of the subsets that its terms fall in only.
3. A long document would have many terms in every subset, so that any edit changed them all.  Hence subsets
   come at levels: level l keeps a random 2**-l of the lexicon.  A fingerprint has two adjacent levels, the
   first such that a subset holds about one term; texts of similar length share a level.
4. The likeness of two fingerprints is the share of equal hashes, at their lowest common level, among the
   subsets that either has terms in.

A document with fewer than ``FEW`` lexicon terms uses all its terms in the same way.

Neighbours: documents are dealt to ranges of (id, text hash) of about as many rows each, and the first document of each range is also sent to
the range before it (to the last one: the first of all).  So one shuffle of the texts serves the edited
texts, the grouping of terms and the comparison with the next document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SPLIT = r"[^\p{L}\p{N}]+"
COMMONEST, RAREST = 0.5, 0.0002          # the band, as shares of the documents
LEXICON = 1_000_000
SUBSETS, TERMS = 32, 48                  # terms at the first level: half of TERMS to TERMS, or all if fewer
FEW = 8
RANGE_ROWS, RANGES = 2_000, 100_000      # documents in a range of ids, and most ranges


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, text: str, commonest: float = COMMONEST, rarest: float = RAREST, most: int = LEXICON) -> DataFrame:
    """(term) within the band: at most ``most`` rows."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    counts = written(counts.filter(F.col("docs").between(max(1, rarest * n), max(1, commonest * n))), "terms")
    # numbers of terms by their number of documents, in bins that grow by a tenth: a few hundred rows
    bins = counts.groupBy(F.floor(F.log(F.col("docs").cast("double")) / F.log(F.lit(1.1))).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for b in bins:
        total += b["n"]
        if total > most:
            break
        least = b["least"]
    return counts.filter(F.lit(False) if least is None else F.col("docs") >= least).select("term")


def level_of(n: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(TERMS))))).cast("int")


def _every(level: Column) -> Column:
    """One in so many of the lexicon's terms is in a level."""
    return F.pow(F.lit(2.0), level).cast("long")


def _picked(term: Column, every: Column) -> Column:
    """The upper hash bits decide on a term's levels, the lower ones on its subset."""
    return F.shiftrightunsigned(term, 40) % every == 0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, not wherever it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprint(kept: Column, level: Column, kind: Column) -> Column:
    """(kind, level, first, second) from the sorted terms ``kept``: hashes of the subsets of two levels."""
    def hashed(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.right(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lit(8))).otherwise(F.lit(""))

    def subsets(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
        return _let(every, lambda e: _let(F.filter(kept, lambda t: _picked(t, e)), lambda own: F.transform(
            numbers, lambda k: _let(F.filter(own, lambda t: F.pmod(t, F.lit(SUBSETS)) == k), hashed))))
    return F.struct(kind.alias("kind"), level.alias("level"), subsets(_every(level)).alias("first"), subsets(_every(level + 1)).alias("second"))


def fingerprint_text(f: Column) -> Column:
    return F.concat(f["kind"], f["level"], F.lit(":"), F.array_join(f["first"], "."), F.lit(":"), F.array_join(f["second"], "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes at the lowest common level; 1 for equal fingerprints, 0 without a common level."""
    x = F.when(a["level"] >= b["level"], a["first"]).otherwise(a["second"])
    y = F.when(b["level"] >= a["level"], b["first"]).otherwise(b["second"])
    either = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != "") | (q != "")), lambda z: z))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != "") & (p == q)), lambda z: z))
    comparable = (a["kind"] == b["kind"]) & (F.abs(a["level"] - b["level"]) <= 1) & (either > 0)
    return F.when(a == b, F.lit(1.0)).when(comparable, same / either).otherwise(F.lit(0.0))


def range_heads(places: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The least (key, hash) of each of about ``ranges`` ranges with about as many rows each, in order: Spark's own range
    partitioning of the bare places, whatever their distribution.  At most RANGES rows reach the driver."""
    dealt = places.repartitionByRange(ranges, "key_", "hash_").groupBy(F.spark_partition_id().alias("part"))
    heads = dealt.agg(F.min(F.struct("key_", "hash_")).alias("head")).collect()
    return sorted((r["head"]["key_"], r["head"]["hash_"]) for r in heads)


def range_of(key: Column, hash_: Column, heads: list[tuple[int, int]]) -> Column:
    """The number of the range, by binary search among the heads."""
    inner = heads[1:]                       # what lies before the second head is in range 0
    if not inner:
        return F.lit(0).cast("long")
    keys, hashes = (F.split(F.lit(",".join(str(h[i]) for h in inner)), ",").cast("array<long>") for i in (0, 1))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        k, h = F.get(keys, mid), F.get(hashes, mid)
        reached = (s["low"] < s["high"]) & ((k < key) | ((k == key) & (h <= hash_)))
        return F.struct(F.when(reached, mid + 1).otherwise(s["low"]).alias("low"),
                        F.when(reached | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(inner)).alias("high"))
    steps = F.array_repeat(F.lit(0), len(inner).bit_length() + 1)
    return F.aggregate(steps, start, halve)["low"].cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range_, place_, guest_, id_, text_, next_): every document with the text of the next one by ascending
    id (nulls first, equal ids in the order of their texts' hashes), after the last the first.  guest_ rows
    are the copies that stand after the last document of a range."""
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    ids = rows.agg(F.min(F.col("id_").cast("long")).alias("low"), F.count(F.lit(1)).alias("n")).first()
    low = (ids["low"] if ids["low"] is not None else 0) - 1
    rows = rows.withColumn("key_", F.coalesce(F.col("id_").cast("long"), F.lit(low))).withColumn("hash_", F.xxhash64("text_"))
    heads = range_heads(rows.select("key_", "hash_"), min(RANGES, -(-ids["n"] // RANGE_ROWS)) or 1)
    rows = rows.withColumn("range_", range_of(F.col("key_"), F.col("hash_"), heads))
    # the first document of each range also stands after the last one of the range before (for the first: of the last)
    guests = [((k or len(heads)) - 1, *head, k == 0) for k, head in enumerate(heads)]
    host = docs.sparkSession.createDataFrame(guests, "range_ long, key_ long, hash_ long, after_ boolean")
    visiting = rows.drop("range_").join(F.broadcast(host), ["key_", "hash_"]).dropDuplicates(["range_", "key_", "hash_"])
    home = rows.withColumn("after_", F.lit(False)).withColumn("guest_", F.lit(False))
    cols = ["range_", "key_", "hash_", "after_", "guest_", "id_", "text_"]
    both = home.select(cols).union(visiting.withColumn("guest_", F.lit(True)).select(cols))
    order = Window.partitionBy("range_").orderBy("after_", "key_", "hash_", "guest_")
    return both.withColumn("place_", F.row_number().over(order)).withColumn("next_", F.lead("text_").over(order))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first code
    points of the next document by ascending id (after the last: the first), or all of them if it has fewer.
    Null texts count as empty.  Equal texts have equal fingerprints; a text without terms has that of no
    terms.  Null ids come first, repeated rows follow each other; extra columns are ignored; an empty table
    gives an empty result, and a single document is its own next one."""
    words = lexicon(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text_")), "text_")
    rows = with_next(docs, id_col, text_col)
    n = F.length("text_")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text_"), n - cut), F.left(F.coalesce("next_", F.lit("")), cut))
    rows = rows.withColumn("edited_", F.when(F.col("guest_"), F.lit("")).otherwise(edited)) \
        .select("range_", "place_", "guest_", "id_", n.cast("long").alias("n_chars"), F.sha2("edited_", 256).alias("edited_sha256"),
                terms(F.col("text_")).alias("t0_"), terms(F.col("edited_")).alias("t1_"))
    rows = rows.withColumn("d0_", _every(level_of(F.size("t0_")))).withColumn("d1_", _every(level_of(F.size("t1_"))))
    facts = ["guest_", "id_", "n_chars", "edited_sha256", "d0_", "d1_"]

    def tagged(which: int) -> Column:
        return F.transform(f"t{which}_", lambda t: F.struct(F.lit(which).alias("w"), t.alias("term")))
    single = rows.select("range_", "place_", *facts, F.explode_outer(F.concat(tagged(0), tagged(1))).alias("x")) \
        .select("range_", "place_", *facts, "x.w", "x.term")
    known = single.join(F.broadcast(words.withColumn("known_", F.lit(True))), "term", "left")
    # of terms outside the lexicon only those of the level that all terms of the text would give
    spare = F.col("known_").isNull() & _picked(F.col("term"), F.when(F.col("w") == 0, F.col("d0_")).otherwise(F.col("d1_")))
    lists = [F.collect_list(F.when((F.col("w") == w) & cond, F.col("term"))).alias(f"{name}{w}_")
             for w in (0, 1) for name, cond in (("in", F.col("known_").isNotNull()), ("out", spare))]
    grouped = known.groupBy("range_", "place_").agg(*[F.first(c).alias(c) for c in facts], *lists)
    for w in (0, 1):
        inside, every = F.col(f"in{w}_"), F.col(f"d{w}_")
        few = F.size(inside) < FEW
        kept = F.sort_array(F.when(few, F.concat(F.filter(inside, lambda t: _picked(t, every)), F.col(f"out{w}_"))).otherwise(inside))
        level = F.when(few, F.log2(every.cast("double")).cast("int")).otherwise(level_of(F.size(inside)))
        grouped = grouped.withColumn(f"f{w}_", _let(kept, lambda x: fingerprint(x, level, F.when(few, F.lit("a")).otherwise(F.lit("b")))))
    follow = Window.partitionBy("range_").orderBy("place_")
    out = grouped.select("range_", "place_", *facts, "f0_", "f1_").withColumn("next_f_", F.lead("f0_").over(follow)).filter(~F.col("guest_"))
    f0, f1, f2 = F.col("f0_"), F.col("f1_"), F.col("next_f_")
    return out.select(F.col("id_").alias(id_col), "n_chars", "edited_sha256", fingerprint_text(f0).alias("fingerprint"),
                      fingerprint_text(f1).alias("edited_fingerprint"), likeness(f0, f1).alias("near_edited"),
                      likeness(f0, f2).alias("near_next"))
