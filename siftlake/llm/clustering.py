"""Centroid clustering of integer vectors, exact, with bounds loosened by geometry.

Each component x becomes floor(scale * x).  A vector keeps its cluster, an upper bound of the
distance to its centroid and a lower bound of the distance to every other one.  When centroids move,
the upper bound grows by the drift of its own centroid.  The lower bound falls by less than the
others' largest drift: a cluster lies within a sphere, and how much nearer a moved centroid can have
come to any point of a sphere follows from the plane through the sphere's centre and the move (see
``loosening``).  Vectors whose upper bound stays below the lower one, or below half the distance to
the next centroid, keep their cluster unseen; the others are compared with all centroids, in integers.
The floating-point bounds are widened by more than their rounding, so they never decide a tie.

Vectors are packed into blocks of BLOCK and written once as a table bucketed by block; each round
writes only the state of the blocks (cluster and bounds, 20 bytes a vector), bucketed alike, so the
join of the two never shuffles.  A block returns the sums of the vectors that changed cluster.  What
comes to the driver each round is k centroids, k counts and k radii, whatever the table's size.

Vectors that are null, of another length, or with null or non-finite components take no part.
Repeated rows are vectors of their own.  Fewer vectors than k give as many centroids; none give no
rows.  An id of null hashes as ``null``; ids with equal hashes start in the order of their vectors.
Components beyond LIMIT after scaling are refused with an error, as squared distances would not fit
into 64 bits.  Other columns of the input play no part."""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.llm.common import ship, shuffle_partitions
from siftlake.session import cut, fresh_path

BLOCK = 1_024  # vectors in a block
BUCKET_BLOCKS = 128  # blocks in a bucket, on average: what a task reads
BATCH_BLOCKS = 16  # blocks that go to a Python worker at a time
MOST_BUCKETS = 100_000  # that Spark allows by default
LIMIT = 1 << 27
_SLACK = 1e-12  # of bounds, relative; their rounding is below 1e-15 a step


def loosening(before: np.ndarray, after: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """At least the most by which any point of a sphere has come nearer to a centroid that moved
    from ``before`` to ``after``; negative if all points are farther from it than they were.

    With D the length of the move, m its middle and t how far a point x lies along it from m,
    |x - before| - |x - after| = 2 D t / (|x - before| + |x - after|).  The sum below the line is
    at least 2 |x - m|, so the difference is at most D cos(angle), where the angle is the one
    between the move and x as seen from m.  Over the sphere it is at least the angle to its centre
    less that of its radius.  If that is above 90 degrees, t is negative, and the sum, at most
    2 |x - m| + D, gives a bound below zero."""
    move, away = after - before, centre - (before + after) / 2
    length, far = float(np.linalg.norm(move)), float(np.linalg.norm(away))
    if length == 0:
        return 0.0
    if far <= radius * (1 + _SLACK):
        return length * (1 + _SLACK)
    angle = (math.acos(max(-1.0, min(1.0, float(away @ move) / (far * length)))) - math.asin(min(1.0, radius / far)))
    most = math.cos(max(0.0, min(math.pi, angle)))
    if most < 0:
        most *= (far - radius) / (far - radius + length / 2)
    return min(length * (1 + _SLACK), length * (most + 1e-6))


class Step:
    """What a round tells every task: the centroids, and how the old bounds change."""

    def __init__(self, centroids: np.ndarray, previous: np.ndarray | None = None, radii: list[float] | None = None):
        self.centroids = centroids
        points, k = centroids.astype(np.float64), len(centroids)
        apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - _SLACK)
        if previous is not None:
            old = previous.astype(np.float64)
            self.drift = np.sqrt(((points - old) ** 2).sum(axis=1)) * (1 + _SLACK)
            self.loosen = np.array([max((loosening(old[j], points[j], old[i], radii[i]) for j in range(k) if j != i), default=0.0)
                                    for i in range(k)])


def _squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = points - centroid
    return (apart * apart).sum(axis=1)


def assign(points: np.ndarray, step: Step, state=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each vector, and how many were compared with all centroids."""
    n, k = len(points), len(step.centroids)
    if state is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        cluster, upper, lower = (x.copy() for x in state)
        drift, loosen = step.drift[cluster], step.loosen[cluster]
        upper += drift + _SLACK * (upper + drift + 1)
        lower -= loosen + _SLACK * (np.abs(lower) + np.abs(loosen) + 1)
        least = np.maximum(lower, step.half[cluster])
        open_ = np.flatnonzero(upper >= least)
        if len(open_):  # the true distance may do
            true = np.sqrt(_squared(points[open_], step.centroids[cluster[open_]]).astype(np.float64)) * (1 + _SLACK)
            upper[open_] = true
            open_ = open_[true >= least[open_]]
    if len(open_):
        some = points[open_]
        squares = np.stack([_squared(some, c) for c in step.centroids], axis=1)
        best = squares.argmin(axis=1)  # of equal ones the first
        at = np.arange(len(some))
        cluster[open_], upper[open_] = best, np.sqrt(squares[at, best].astype(np.float64)) * (1 + _SLACK)
        if k > 1:
            squares[at, best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(squares.min(axis=1).astype(np.float64)) * (1 - _SLACK)
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, len(open_)


_STATE = "block long, cluster binary, upper binary, lower binary, moved array<long>, radius array<double>, scanned long"


def _unpacked(points: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(points, np.int32).reshape(-1, dimensions).astype(np.int64)


def _round(step: Step, dimensions: int):
    k = len(step.centroids)

    def one(row: dict) -> dict:
        points, old = _unpacked(row["points"], dimensions), None
        if row.get("cluster") is not None:
            old = tuple(np.frombuffer(row[c], t) for c, t in (("cluster", np.int32), ("upper", np.float64), ("lower", np.float64)))
        cluster, upper, lower, scanned = assign(points, step, old)
        moved = np.zeros((k, dimensions + 1), np.int64)  # counts, then sums
        changed = np.arange(len(points)) if old is None else np.flatnonzero(cluster != old[0])
        for j in range(k):
            come = changed[cluster[changed] == j]
            moved[j, 0] += len(come)
            moved[j, 1:] += points[come].sum(axis=0)
            if old is not None:
                gone = changed[old[0][changed] == j]
                moved[j, 0] -= len(gone)
                moved[j, 1:] -= points[gone].sum(axis=0)
        radius = [float(upper[cluster == j].max(initial=0.0)) for j in range(k)]
        return {"block": row["block"], "cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(),
                "moved": moved.ravel().tolist(), "radius": radius, "scanned": scanned}

    schema = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
                        ("moved", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64())), ("scanned", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row) for row in batch.to_pylist()], schema=schema)
    return run


def _last(step: Step, dimensions: int):
    """Each vector's cluster and exact squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points = _unpacked(row["points"], dimensions)
                old = tuple(np.frombuffer(row[c], t) for c, t in (("cluster", np.int32), ("upper", np.float64), ("lower", np.float64)))
                cluster, *_ = assign(points, step, old)
                yield pa.record_batch({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster),
                                       "distance": pa.array(_squared(points, step.centroids[cluster]))})
    return run


def _pack(scale: float, dimensions: int):
    """Blocks of the integer vectors of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def block(n: int) -> pa.RecordBatch:
            whole = np.concatenate(parts)
            out = pa.record_batch({"ids": pa.array([ids[:n]], pa.list_(pa.int64())),
                                   "points": pa.array([whole[:n].tobytes()], pa.binary())})
            ids[:], parts[:] = ids[n:], [whole[n:]]
            return out

        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * flat).reshape(batch.num_rows, dimensions)
            if len(whole) and np.abs(whole).max() > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling by {scale}")
            ids += batch.column("vec_id").to_pylist()
            parts.append(whole.astype(np.int32))
            while len(ids) >= BLOCK:
                yield block(BLOCK)
        if ids:
            yield block(len(ids))
    return run


def usable(vectors: DataFrame, dimensions: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    return rows.where((F.size("vector") == dimensions) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def start(rows: DataFrame, k: int, scale: float, seed: str) -> list[list[int]]:
    """The integer vectors of the k smallest hashes of ``seed:id``; k rows come to the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.orderBy(F.sha2(name, 256), "vector").limit(k).collect()
    return [[math.floor(scale * x) for x in r["vector"]] for r in first]


@contextlib.contextmanager
def _few_blocks_at_a_time(spark: SparkSession):
    """Blocks are wide rows: only so many of them go to a worker at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class _Tables:
    """Tables in the shared folder, bucketed by block; only their names are dropped at the end."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"siftlake_{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "block").sortBy("block").option("path", fresh_path(self.spark, name)).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[float], int]:
    """By how much counts and sums change, the radius of each cluster, how many vectors were scanned."""
    moved = np.zeros(k * width, dtype=object)
    for at, by in (state.select(F.posexplode("moved").alias("at", "by")).where("by <> 0")
                   .groupBy("at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by")).collect()):
        moved[at] = int(by)
    *radii, scanned = state.agg(*[F.max(F.get("radius", F.lit(j))) for j in range(k)], F.sum("scanned")).first()
    return moved.reshape(k, width), [float(r or 0.0) for r in radii], int(scanned or 0)


def by_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster, from k literals."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: float = 1024.0,
            seed: str = "3", id_col: str = "vec_id", vector: str = "embedding", told: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 per vector that
    takes part.  ``told`` gets, per round, how many vectors were compared with all centroids."""
    spark = vectors.sparkSession
    rows = usable(vectors, dimensions, id_col, vector)
    first = start(rows, k, scale, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    if max(abs(x) for c in first for x in c) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling by {scale}")
    k, centroids = len(first), np.array(first, dtype=np.int64)
    packed = cut(rows.mapInArrow(_pack(scale, dimensions), "ids array<long>, points binary")
                 .withColumn("block", F.monotonically_increasing_id()), "packed")
    blocks = packed.count()
    buckets = min(MOST_BUCKETS, max(min(blocks, shuffle_partitions(spark)), -(-blocks // BUCKET_BLOCKS)))
    tables, totals = _Tables(spark, buckets), np.zeros((k, dimensions + 1), dtype=object)
    try:
        points = tables.write(packed.repartition(buckets, "block"), "points")
        with _few_blocks_at_a_time(spark):
            step, state = Step(centroids), None
            for _ in range(rounds):
                now = points.select("block", "points")
                now = now if state is None else now.join(state.select("block", "cluster", "upper", "lower"), "block")
                state = tables.write(now.mapInArrow(_round(step, dimensions), _STATE), "state")
                moved, radii, scanned = _sums(state, k, dimensions + 1)
                if told is not None:
                    told.append(scanned)
                totals = totals + moved
                after = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else c for t, c in zip(totals, centroids.tolist())],
                                 dtype=np.int64)
                step, centroids = Step(after, centroids, radii), after
            if state is None:  # no round at all
                state = tables.write(points.select("block", "points").mapInArrow(_round(step, dimensions), _STATE), "state")
                step = Step(centroids, centroids, _sums(state, k, dimensions + 1)[1])
            last = points.join(state.select("block", "cluster", "upper", "lower"), "block")
            found = cut(last.mapInArrow(_last(step, dimensions), "vec_id long, cluster int, distance long"), "clusters")
    finally:
        tables.forget()
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select("vec_id", "cluster", "distance", by_cluster([inertia.get(j, 0) for j in range(k)], "long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(names, "string").alias("centroid_sha256"))


ship(__name__)
