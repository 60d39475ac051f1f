"""Merkle manifest of a dataset: one tree per group, one over the groups, and a proof for every row.

A leaf is the SHA-256 of a row's fields; every ``fan`` consecutive nodes of a level (the last ones may be fewer) hash
to their parent until one is left.  A level needs no join: the rows of a group lie in order of their position, a node
of level l stands in the row of its first leaf (``pos % fan**l == 0``), and so its siblings are a fixed number of rows
away.  Per level, lag and lead columns of those fixed offsets, masked by the node's slot and by the length of its run,
are the siblings, and the rows of first children hash the parent.

Windows hold ``fan ** LEVELS`` rows of a group at most: a bucket of that many leaves is a whole subtree, so no run
crosses its border.  The buckets' digests are the leaves of the next pass, and the proofs found there go down to the
rows by (group, bucket).  The roots of the groups are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .numbering import numbered, placed

LEVELS = 6             # levels that one pass over the windows climbs
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Fields as UTF-8 byte count, ':' and value, '-' for null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def climb(nodes: DataFrame, fan: int, proofs: bool) -> DataFrame:
    """``nodes`` (key, pos, total, hash) with ``bucket``, ``hash`` replaced by that of the node above (to be read in the
    bucket's first row), and with ``proofs`` the steps to it as ``path``."""
    x = nodes.withColumn("bucket", F.floor(F.col("pos") / fan ** LEVELS))
    rows = Window.partitionBy("key", "bucket").orderBy("pos")
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    steps = []
    for level in range(LEVELS):
        offset = fan ** level
        place = F.floor(F.col("pos") / offset)
        many = F.ceil(F.col("total") / offset)                # nodes of the level
        slot = place % fan
        run = F.least(F.lit(fan), many - place + slot)
        before = [F.when(slot >= k, F.lag("hash", k * offset).over(rows)) for k in range(fan - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead("hash", k * offset).over(rows)) for k in range(1, fan)]
        names = [f"b{level}", f"a{level}"]
        none = F.lit("")
        x = x.withColumns({names[0]: F.concat(*[F.coalesce(c, none) for c in before]), names[1]: F.concat(*[F.coalesce(c, none) for c in after])})
        x = x.withColumn("hash", F.when(many > 1, digest(F.col("hash"), F.col(names[1]))).otherwise(F.col("hash")))
        if proofs:
            # the leaves below a node take its siblings from the node's row, the last such row so far
            own = [F.col(n) if level == 0 else F.last(F.when(F.col("pos") % offset == 0, F.col(n)), ignorenulls=True).over(so_far) for n in names]
            steps.append(F.when(many > 1, F.struct(own[0].alias("before"), own[1].alias("after"))))
    if proofs:
        x = x.withColumn("path", F.array_compact(F.array(*steps)))
    return x.drop(*[f"{n}{level}" for n in "ab" for level in range(LEVELS)])


def prove(nodes: DataFrame, fan: int, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (key, pos, total, hash and others) without the hash, but with ``path`` and what else ``crown`` gives.

    ``crown`` gives (key, path, ...) of the nodes that are left, one per key.  ``most`` is the largest total."""
    if most <= 1:
        return nodes.join(crown(nodes.select("key", "hash")), "key").drop("hash")
    top = climb(nodes.select("key", "pos", "total", "hash"), fan, False).filter(F.col("pos") % fan ** LEVELS == 0)
    above = written(top.select("key", F.col("bucket").alias("pos"), F.ceil(F.col("total") / fan ** LEVELS).alias("total"), "hash"), "merkle-nodes")
    upper = prove(above, fan, -(-most // fan ** LEVELS), crown).drop("total") \
        .withColumnsRenamed({"pos": "bucket", "path": "rest"})
    own = climb(nodes, fan, True).drop("hash").join(upper, ["key", "bucket"])
    return own.withColumn("path", F.concat("path", "rest")).drop("bucket", "rest")


def largest(runs: DataFrame) -> int:
    return runs.agg(F.max("total")).first()[0] or 0


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source",
             id_col: str = "doc_id", fan: int = 3, carry: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Per row: id, leaf, path (array of before, after: the concatenated digests of the siblings on either side, from
    the leaf's run up to the root's), subroot (of its group), root, and the ``carry`` columns (name, expression).

    Within a group leaves ascend by id, null ids first, equal ids by their leaf; groups ascend bytewise, null first.
    Repeated rows are leaves of their own.  Nulls, empty texts and the number 0 have different leaves.  Extra columns
    are ignored whatever their names; an empty table has no rows.  Texts of any length are hashed in the scan, only
    digests are shuffled."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))      # "" is null: first in order
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.unhex(leaf_digest(*map(F.col, fields))).alias("leaf"),
                       *[c.alias(f"carry{i}") for i, (_, c) in enumerate(carry)])
    leaves, runs = numbered(rows, "key", ["id", "leaf"], "merkle-leaves")

    def of_groups(tops: DataFrame) -> DataFrame:
        groups = tops.select(F.lit(0).alias("key"), F.col("key").alias("group"), "hash")
        nodes, one = numbered(groups, "key", ["group"], "merkle-groups")
        return prove(placed(nodes, one, "key").withColumn("subroot", F.col("hash")), fan, largest(one), of_root).select(F.col("group").alias("key"), "path", "subroot", "root")

    def of_root(top: DataFrame) -> DataFrame:
        return top.select("key", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    leaves = placed(leaves, runs, "key").withColumn("leaf", F.lower(F.hex("leaf"))).withColumn("hash", F.col("leaf"))
    out = prove(leaves, fan, largest(runs), of_groups)
    return out.select(F.col("id").alias(id_col), "leaf", "path", "subroot", "root", *[F.col(f"carry{i}").alias(n) for i, (n, _) in enumerate(carry)])


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' digests, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))
