"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from siftlake.llm import hard_negatives as H
from siftlake.workload.check import compare, connect
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def _brute(rows, every, positives=5, negatives=10):
    rows = sorted({(i, tuple(np.float32(x).item() for x in v), c) for i, v, c in rows if i is not None and v and c is not None
                   and all(x is not None and math.isfinite(x) for x in v)})
    ints = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows]
    out = []
    for a, (i, v, c) in enumerate(ints):
        if i % every:
            continue
        scores = [sum(x * y for x, y in zip(v, w)) if len(w) == len(v) else None for _, w, _ in ints]
        order = sorted((b for b in range(len(ints)) if b != a and scores[b] is not None), key=lambda b: (-scores[b], ints[b][0]))
        for p in [b for b in order if ints[b][2] == c][:positives]:
            hits = [b for b in order if ints[b][2] != c and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out += [(i, ints[p][0], n + 1, ints[b][0], scores[p], scores[b]) for n, b in enumerate(hits[:negatives])]
    return sorted(out)


def _mined(df, every, **more):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in H.mine(df, df.where(f"vec_id % {every} = 0"), **more).collect())


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op11_hard_negatives"](spark, SF), connect(SF), entry.oracle_sql()["op11_hard_negatives"]) == ""


def test_blocks_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "ANCHORS", 6)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 1)) * rng.randint(0, 3) / 2 + 0.25 for _ in range(5)], rng.randint(0, 2)) for i in range(300)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(120)]  # a hot vector
    df = spark.createDataFrame(rows + rows[:30], KIND).repartition(5)
    assert _mined(df, 10) == _brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (1, [0.5, 0.25], 2), (2, None, 1), (3, [nan, 1.0], 2), (4, [inf, 0.0], 2),
            (5, [None, 1.0], 2), (6, [], 2), (7, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (8, [0.5, 0.5, 0.5], 2), (9, [0.25, 0.5], 3)]
    df = spark.createDataFrame(rows, KIND)
    assert _mined(df, 10) == _brute(rows, 10) != []
    assert _mined(df.limit(0), 10) == []
    more = df.selectExpr("*", "1 AS dim", "2 AS key", "3 AS rb", "4 AS vector", "5 AS rank")
    assert _mined(more, 10) == _brute(rows, 10)


def test_rows_of_one_id_mine_for_themselves(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.25, 0.75], 2)]
    assert _mined(spark.createDataFrame(rows, KIND), 10) == _brute(rows, 10)


@pytest.mark.parametrize("dim,reach", [(3, 10), (64, 500), (200, 5_000), (64, 1e9), (70, 1e17)])
def test_scores_are_exact(dim, reach):
    rng = np.random.default_rng(int(dim + reach))
    a, b = (np.floor((rng.random((7, dim)) - 0.5) * 2 * reach) for _ in range(2))
    got = H.exact_scores(H.Components(a), H.Components(b))
    want = [[sum(int(x) * int(y) for x, y in zip(u, w)) for w in b] for u in a]
    assert got.tolist() == [[max(-(1 << 63), min((1 << 63) - 1, s)) for s in row] for row in want]
