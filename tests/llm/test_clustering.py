"""Centroid clustering against plain integers, and the geometry of its bounds."""

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from siftlake.llm import clustering as C
from siftlake.workload.check import compare, connect
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"
NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _brute(rows, dim, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * np.float32(x).item()) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, near) if at == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[j]
    of = [sum(d for d, at in near if at == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, of[j], sum(of), names[j]) for (i, _), (d, j) in zip(kept, near)), key=str)


def _made(df, **more):
    return sorted((tuple(r[n] for n in NAMES) for r in C.cluster(df, **more).collect()), key=str)


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op13_clustering"](spark, SF), connect(SF), entry.oracle_sql()["op13_clustering"]) == ""


def test_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 30)
    monkeypatch.setattr(C, "BUCKET_BLOCKS", 3)
    rng = random.Random(4)
    rows = [(i, [rng.randint(-3, 3) / 1024 for _ in range(3)], 0) for i in range(400)]
    rows += [(500 + i, [-2.5 / 1024, 0.0, 1.0], 0) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20], KIND).repartition(7)
    told = []
    assert _made(df, dimensions=3, told=told) == _brute(rows + rows[:20], 3)
    assert told[0] == 620 and len(told) == 10


def test_few_odd_and_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, -2.0], 1), (3, None, 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0),
            (7, [1.0], 0), (None, [3.0, 3.0], None), (1, [1.0, 2.0], 0), (1, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS block", "2 AS vector", "3 AS cluster", "4 AS points")
    for k, rounds in ((8, 10), (2, 3), (1, 2), (2, 0)):
        assert _made(df, k=k, rounds=rounds, dimensions=2) == _brute(rows, 2, k, rounds)
    assert _made(df.limit(0), dimensions=2) == [] == _made(df, dimensions=5)
    assert [f.name for f in C.cluster(df.limit(0)).schema] == list(NAMES)
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e20, 0.0], 0)], KIND), dimensions=2)


def test_join_of_blocks_and_state_has_no_exchange(spark):
    tables = C._Tables(spark, 4)
    left, right = (tables.write(spark.range(50).selectExpr("id AS block", f"id AS {n}").repartition(4, "block"), n) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "block")
        assert joined.count() == 50
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.forget()


def test_loosening_is_a_bound_and_below_the_drift():
    rng = np.random.default_rng(9)
    less = 0
    for _ in range(3_000):
        d = int(rng.integers(2, 6))
        before, centre = rng.normal(size=d) * 5, rng.normal(size=d) * 5
        after, radius = before + rng.normal(size=d) * 10 ** rng.uniform(-2, 1), 10 ** rng.uniform(-2, 1)
        bound, drift = C.loosening(before, after, centre, radius), np.linalg.norm(after - before)
        out = rng.normal(size=(60, d))
        x = centre + radius * out / np.linalg.norm(out, axis=1, keepdims=True) * rng.random((60, 1)) ** 0.2
        nearer = np.linalg.norm(x - before, axis=1) - np.linalg.norm(x - after, axis=1)
        assert nearer.max() <= bound <= drift * (1 + 1e-9)
        less += bound < 0.9 * drift
    assert less > 1_000
    assert C.loosening(np.zeros(2), np.zeros(2), np.ones(2), 1.0) == 0.0


def test_bounds_keep_and_save_scans():
    """Every kept bound holds at every round, and the geometry scans fewer vectors than full drifts do."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 16)) * 300
    points = np.floor(middles[rng.integers(0, 8, 4_000)] + rng.normal(size=(4_000, 16)) * 120).astype(np.int64)
    scans = []
    for full in (False, True):
        centroids, state, scanned = points[:8].copy(), None, 0
        step = C.Step(centroids)
        for _ in range(12):
            *state, more = C.assign(points, step, state)
            scanned += more
            apart = np.sqrt(np.stack([C._squared(points, c) for c in centroids], axis=1).astype(float))
            own = apart[np.arange(len(points)), state[0]]
            assert (state[0] == apart.argmin(axis=1)).all() and (state[1] >= own).all()
            apart[np.arange(len(points)), state[0]] = np.inf
            assert (state[2] <= apart.min(axis=1)).all()
            radii = [float(state[1][state[0] == j].max(initial=0)) for j in range(8)]
            after = np.array([points[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) for j in range(8)])
            step = C.Step(after, centroids, radii)
            if full:
                step.loosen = np.array([max(step.drift[j] for j in range(8) if j != i) for i in range(8)])
            centroids = after
        scans.append(scanned)
    assert scans[0] < scans[1]
