"""Nearest neighbours against brute force."""

import numpy as np

import __spark_entry__ as entry
from siftlake.llm import neighbours
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def _brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_of_the_query(spark):
    rows = entry.queries()["op9_neighbours"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == ids[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        want = _brute(ids, x, q, 10)
        hits += len({v for v, _ in want} & {v for _, v, _ in mine})
        total += 10
        exact = {int(i): d for i, d in zip(ids, np.sqrt(((x - x[q]) ** 2).sum(axis=1)))}
        assert all(abs(exact[v] - s) < 1e-12 for _, v, s in mine)
    assert hits >= 0.95 * total


def test_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTORS", 60)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[100:220] = x[0]
    data = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(data + data[:50], KIND)
    rows = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 10).collect()
    for q in range(0, 400, 50):
        mine = [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        want = _brute(np.arange(400), x.astype(float), q, 10)
        assert len({v for v, _ in mine} & {v for v, _ in want}) >= 9 and len(mine) == 10
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(100, 110))


def test_few_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
            (6, [None, 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (100, None, 1)]
    df = spark.createDataFrame(data, KIND)
    rows = neighbours.nearest(df, df.where("vec_id % 100 = 0"), 10).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 1, 8), (0, 2, 1)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
