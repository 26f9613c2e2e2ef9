"""Connected components: union-find inside each partition, then star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siftlake.llm.common import ship
from siftlake.session import cut


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's edges as (node, smallest node it reaches here)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i:i + 50_000]
        yield pd.DataFrame({"u": part, "v": [root(x) for x in part]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node goes to the smallest of them, the node too."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, and that smallest node.
    ``edges`` has columns u and v, in any order."""
    now = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v")
    now = cut(now.mapInPandas(_forest, "u long, v long").where("u <> v").distinct(), "forest")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now
        before = tuple(state)
        now = cut(_small_star(cut(_large_star(now), "large")), "small")


ship(__name__)
