"""Giant files in chunks give what whole files give, whatever the size of the chunks."""

import random

import pytest

from siftlake.operators import chunks as C
from siftlake.operators.lines import annotated_lines
from siftlake.plans import scan
from siftlake.sources import corpus
from siftlake.workload.bank import BANK

from tests import brute

PARTS = ['"""', "'''", '"""a"""', "'''a'''", "/*", "*/", "/* a */", "*/ /*", "x = 1", "", "def a(x):", "  def b():", "class C:",
         "class D: '''", 'def e(): """', "# TODO", "import os", 'password = "abc"', "for i in range(len(x)):"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(160):
        parts = PARTS + (BANK if i % 2 else [])
        text = rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(parts) for _ in range(rng.randrange(90)))
        out.append((rng.choice(["r", "s", None]), f"d/f{i}{rng.choice(['.py', '.py', '.rb', '.js', '.go', '.txt'])}", text + rng.choice(["", "\n"])))
    return out + [("r", "none.py", None), ("r", "empty.py", ""), ("r", "a b.py", "x\n" * 501)]


def _sorted(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("size,fan", [(1, 2), (12, 3), (40, 64), (200, 2), (1 << 20, 64)])
def test_lines_of_chunks_equal_lines_of_files(make_files, monkeypatch, rows, size, fan):
    monkeypatch.setattr(C, "FAN", fan)
    files = make_files(rows, 3)
    got = C.annotated_chunks(C.placed_chunks(C.split_chunks(files, size)))
    want = annotated_lines(files)
    marks = "CASE WHEN undocumented IN ('F', 'K') THEN undocumented END AS undocumented"
    columns = ["repo_id", "path", "ext", "n_lines", "line", "raw", "stripped", "masked", marks]
    assert _sorted(got.selectExpr(*columns)) == _sorted(want.selectExpr(*columns))


def test_state_of_chunks_equals_fold(make_files, rows):
    got = {(r.path, r.line): r.masked for r in C.annotated_chunks(C.placed_chunks(C.split_chunks(make_files(rows), 25))).collect()}
    for _, path, content in rows:
        lines = (content or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") if content is not None else []
        for n, masked in enumerate(brute.masked_lines(lines, "." + path.rsplit(".")[-1]), 1):
            assert got[(path, n)] == masked, (path, n)


def test_findings_with_giant_files(make_files, rows):
    files = make_files(rows, 2)
    want = _sorted(scan.own_findings(files))
    assert want and _sorted(scan.own_findings(files, giant_bytes=60)) == want
    assert _sorted(scan.own_findings(files, giant_bytes=1 << 30)) == want
    assert _sorted(scan.own_findings(files.limit(0), giant_bytes=60)) == []


def test_turns_compose(spark):
    """``translate`` is the composition of two turns."""
    from itertools import product

    from pyspark.sql import functions as F

    turns = ["".join(t) for t in product("012", repeat=3)]
    pairs = spark.createDataFrame(list(product(turns, turns)), "a string, b string")
    for r in pairs.select("a", "b", C._then(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == "".join(r.b[int(x)] for x in r.a)


def test_many_levels(make_files, monkeypatch):
    """A file of 300 chunks in a tree of pairs."""
    monkeypatch.setattr(C, "FAN", 2)
    lines = ['"""' if i % 7 == 3 else f"x{i}" for i in range(300)]
    placed = C.placed_chunks(C.split_chunks(make_files([("r", "a.py", "\n".join(lines))]), 1))
    assert placed.count() == 300
    got = {r.line: r.masked for r in C.annotated_chunks(placed).collect()}
    assert [got[i + 1] for i in range(300)] == brute.masked_lines(lines, ".py")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_blocks_of_files_too_large_for_a_row(spark, make_files, tmp_path, rows, end):
    files = [(r or "r", p, t.replace("\r\n", "\n").replace("\r", "\n").replace("\n", end)) for r, p, t in rows if t]
    for repo, path, text in files:
        at = tmp_path / "c++" / repo / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = C.placed_chunks(corpus.read_line_blocks(spark, str(tmp_path / "c++"), (".py", ".rb", ".js", ".go"), chunk_lines=7))
        assert found.where("chunk > 5").count() > 50
        got = _sorted(scan.own_findings(found))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == _sorted(scan.own_findings(make_files([f for f in files if not f[1].endswith(".txt")])))
