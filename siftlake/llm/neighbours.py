"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on LINES random lines; per line the projections are a sorted array.  A
query opens a window around its own projection on every line and counts for each vector the windows
that hold it.  The first windows hold FIRST vectors a side; the vectors with most collisions are
verified by their exact distance, and the k-th best of them is a radius that holds k vectors.  Then
the windows grow to WIDTH times that radius (virtual rehashing: wider windows on the same arrays),
and all vectors with at least NEED collisions are verified.  A vector within the radius falls into a
window with probability 0.826, and so misses NEED of LINES windows with a probability under 0.1 %.

Vectors are dealt into blocks by hash and queries into blocks of their own; a task searches one
block of vectors for one block of queries, and the best of all blocks are merged.  Every vector is
indexed; blocks hold at most a fixed number of vectors on average, whatever the table's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siftlake.llm.common import ship

LINES = 64
NEED = 43
FIRST = 32  # vectors on each side of the query in the first windows
WIDTH = 2.72  # window on a line, in radii
VECTORS, QUERIES = 8_192, 4_096  # in a block, on average


def _lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(dimensions).standard_normal((dimensions, LINES))


class Index:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = _lines(vectors.shape[1])
        points = vectors @ self.lines
        self.order = np.argsort(points, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(points.T, self.order.astype(np.int64), axis=1)

    def _counts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many windows each vector is."""
        inside = np.concatenate([order[a:b] for order, a, b in zip(self.order, lo.tolist(), hi.tolist())])
        return np.bincount(inside, minlength=len(self.ids))

    def _verified(self, found: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of ``found`` and their distances, ties to the smaller id."""
        distance = np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[found], distance))[:k]
        return found[best], distance[best]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, id, distance) of the k nearest found per query, without vectors of its own id."""
        n, at = len(self.ids), queries @ self.lines
        place = np.stack([np.searchsorted(row, x) for row, x in zip(self.sorted, at.T)], axis=1)
        lo, hi = np.maximum(place - FIRST, 0), np.minimum(place + FIRST, n)
        radius = np.full(len(queries), np.inf)
        for q, query in enumerate(queries):
            counts = self._counts(lo[q], hi[q])
            top = np.argpartition(counts, n - min(n, 8 * k))[n - min(n, 8 * k):]
            top = top[self.ids[top] != query_ids[q]]
            _, distance = self._verified(top, query, k)
            if len(distance) == k:
                radius[q] = distance[-1]
        # equal vectors may differ in the last bits of their projections
        half = WIDTH / 2 * radius[:, None] + 1e-9 * (1.0 + np.abs(at))
        lo = np.stack([np.searchsorted(row, x, "left") for row, x in zip(self.sorted, (at - half).T)], axis=1)
        hi = np.stack([np.searchsorted(row, x, "right") for row, x in zip(self.sorted, (at + half).T)], axis=1)
        out = []
        for q, query in enumerate(queries):
            enough = np.ones(n, bool) if np.isinf(radius[q]) else self._counts(lo[q], hi[q]) >= NEED
            found = np.flatnonzero(enough & (self.ids != query_ids[q]))
            ids, distance = self._verified(found, query, k)
            out += [(int(query_ids[q]), int(self.ids[i]), float(d)) for i, d in zip(ids, distance)]
        return out


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            index = Index(vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["vector"].to_list()).astype(np.float64))
            out = index.search(queries["vec_id"].to_numpy(np.int64), np.stack(queries["vector"].to_list()).astype(np.float64), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector, dim of the rows that take part: with an id, neither null nor empty nor zero, all components
    finite.  Repeated rows of one id and vector count as one."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine & F.exists(v, lambda x: x != 0))
            .dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors``
    found, by Euclidean distance, without those of its own id; fewer if there are fewer.  Vectors
    are compared with those of equal length only."""
    rows, asked = usable(vectors, id_col, vector), usable(queries, id_col, vector)
    v_blocks, q_blocks = max(1, -(-rows.count() // VECTORS)), max(1, -(-asked.count() // QUERIES))
    left = (rows.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    right = (asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))))
    key = ["dim", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _search(k), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ship(__name__)
