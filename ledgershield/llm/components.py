"""Connected components of an undirected link table, as Spark joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"): every step is one grouped minimum and one equi-join on the node, so nothing about the graph
is gathered in the driver but two numbers per round, and the rounds grow with the logarithm of the
longest path.  A node with very many links is a hot join key: its rows are joined by broadcast (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.filter("v > u"), least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(edges, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component and is
    listed too.  Null ends and self-links are ignored; no links give an empty result."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while True:
        turned = written(_large_star(edges, mark[0]), "edges")
        edges = written(_small_star(turned, mark[0]), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(edges.select(F.col("v"), F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
