"""Connected components of a graph given as edges, by alternating stars.

Each round points the larger neighbours of every node at the least one, then the smaller ones, until every node of a
component hangs on its smallest. Minima are partial aggregates. Nodes with more than 1 / HUBS of all edges, of which there
can be 2 * HUBS at most, get their minimum from a broadcast table, so a join's tasks meet no node with more edges than
that; graphs of up to SMALL edges are joined as they are. Each round is cut by a checkpoint; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, few

#: A node is a hub if it has over a HUBS-th of the edges, and over FEW.
HUBS, FEW = 20_000, 100
#: Edges, a few tasks' worth, up to which a graph needs no care for hubs.
SMALL = 160_000


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, least) with the least neighbour of a, and (a, least) of every node; edges has about n rows."""
    told = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    if n <= SMALL:
        return edges.join(told.select("a", "least"), "a"), told.select("a", "least")
    hubs = F.broadcast(told.where(F.col("n") > max(FEW, n // HUBS)).select(F.col("a").alias("hub"), F.col("least").alias("of_hub")))
    marked = edges.join(hubs, F.col("a") == F.col("hub"), "left")
    easy = marked.where("hub IS NULL").select("a", "b").join(told.select("a", "least"), "a")
    return easy.unionByName(marked.where("hub IS NOT NULL").select("a", "b", F.col("of_hub").alias("least"))), told.select("a", "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that has an edge; component is the smallest id reachable. Loops count for nothing."""
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = _sum(now)
    while before[0]:
        n = 2 * before[0]
        own = few(now, n)
        both = own.select("a", "b").union(own.select(F.col("b"), F.col("a")))
        # A node's larger neighbours go to its least one, itself included; then its smaller ones do.
        large = few(_with_least(both, n)[0], n).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = few(large.distinct(), n)
        pairs, least = _with_least(large, n)
        small = few(pairs, n).select(F.col("b").alias("a"), F.col("least").alias("b")).union(few(least, n)).where("a <> b").distinct()
        now = cut(few(small, n))
        after = _sum(now)
        if after == before:
            break
        before = after
    ends = few(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct(), before[0])
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(ends)
