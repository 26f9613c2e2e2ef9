"""Trees of files read on executors, beside Spark's own reader."""

import gzip
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.sources import corpus, tree

TEXTS = [b"", b"\n", b"a", b"a\r", b"a\r\n", b"\r\n\r\n", b"\r\r\n\n\rx", b"a\nb\r\nc\rd", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", b"\xef\xbb\xbfa\nb",
         b"a\n\xef\xbb\xbfb", b"\xff\xfea\ncaf\xc3\xa9\n", b"x" * 900 + b"\r\n" + b"y" * 300 + b"\n", b"\n" * 700]
NAMES = ["a.py", "b.txt", ".hidden.py", "_under.py", "_k=v.py", "_metadata.py", "_metadata=.py", "x._COPYING_", "s p+%20.py", "{b}[c]*?.py",
         "caf\xe9.py", "\\d.py", "name=__HIVE_DEFAULT_PARTITION__", "_metadata=x._COPYING_"]
FOLDERS = ["r", "r/src", "r/.git", "r/_tmp", "r/_k=1", "r/_metadata", "r/y._COPYING_", "{s}", "deep/a/b/c/d"]


@pytest.fixture
def split(spark):
    """Sets the bytes of a block."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield put
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def odd_tree(tmp_path):
    rng = random.Random(4)
    for folder in FOLDERS:
        (tmp_path / "c++ %41" / folder).mkdir(parents=True, exist_ok=True)
        for name in NAMES:
            (tmp_path / "c++ %41" / folder / name).write_bytes(rng.choice(TEXTS) or b"z")
    for i, text in enumerate(TEXTS):
        (tmp_path / "c++ %41" / "r" / f"t{i}.py").write_bytes(text)
    (tmp_path / "c++ %41" / "r" / "g{1}.py.gz").write_bytes(gzip.compress(b"u\nv\r\nw"))
    (tmp_path / "c++ %41" / "r" / "h.gz").write_bytes(gzip.compress(b"\n".join(b"%d" % i for i in range(40))))
    os.symlink(tmp_path / "c++ %41" / "deep", tmp_path / "c++ %41" / "link")
    os.symlink(tmp_path / "nothing", tmp_path / "c++ %41" / "r" / "gone.py")
    return str(tmp_path / "c++ %41")


def _files(blocks):
    """The lines of each file; its chunks are numbered from 0 without gaps."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.repo_id, r.path, r.chunk)):
        chunks = out.setdefault((r.repo_id, r.path), [])
        assert r.chunk == len(chunks) and r.counted == len(r.lines) > 0
        chunks.append(r.lines)
    return {k: [line for chunk in v for line in chunk] for k, v in out.items()}


@pytest.mark.parametrize("size,extensions", [(128 << 20, None), (400, (".py", ".gz"))])
def test_files_and_lines_are_those_of_sparks_reader(spark, monkeypatch, split, odd_tree, size, extensions):
    with open(os.path.join(os.fsencode(odd_tree), b"r", b"n\xff.py"), "wb") as file:
        file.write(b"x")
    split(4000)  # of Spark's tasks; what they read does not depend on it
    monkeypatch.setattr(tree, "address", lambda *_: None)
    want = _files(corpus.read_line_blocks(spark, odd_tree, extensions, 3))
    monkeypatch.undo()
    split(size)
    monkeypatch.setattr(corpus, "PACKED_FILES", 1)
    for root in (odd_tree, "file:" + odd_tree + "/"):
        assert _files(corpus.read_line_blocks(spark, root, extensions, 3)) == want
    assert len(want) > 40


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 20])
def test_blocks_hold_every_line_once(monkeypatch, piece):
    monkeypatch.setattr(tree, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    texts = TEXTS + [bytes(rng.choice(b"\r\nab") for _ in range(rng.randrange(40))) for _ in range(200)]
    for text in texts:
        body = text.removeprefix(b"\xef\xbb\xbf")
        for block in (1, 2, 3, 11, 10_000):
            found = []
            for start in range(0, len(text), block):
                file = pa.BufferReader(text)
                for run in tree._runs(file, start, min(start + block, len(text)), len(text), 4):
                    assert 0 < len(run) <= 4
                    found += run
            assert found == body.splitlines(), (text, block)


def test_a_run_ends_by_its_bytes_too(monkeypatch):
    monkeypatch.setattr(tree, "ROW_BYTES", 10)
    text = b"abcd\n" * 7 + b"x" * 100
    assert [len(r) for r in tree._runs(pa.BufferReader(text), 0, len(text), len(text), 1000)] == [3, 3, 2]


def test_other_storage_lists_the_same(odd_tree):
    local, top = tree.storage("file:" + odd_tree)
    other = pa.fs.SubTreeFileSystem("/", local)
    for folder in FOLDERS:
        assert sorted(tree._entries(other, f"{top}/{folder}")) == sorted(tree._entries(local, f"{top}/{folder}"))


def test_roots_that_are_left_to_sparks_reader(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x")
    assert tree.address(spark, str(tmp_path)) == f"file:{tmp_path}"
    for root, extensions in ((f"{tmp_path}/[r]", None), (f"{tmp_path}/r/a.py", None), (f"{tmp_path}/none", None), (str(tmp_path), (".p?",))):
        assert tree.address(spark, root, extensions) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_line_blocks(spark, f"{tmp_path}/none")
    (tmp_path / "empty").mkdir()
    assert corpus.read_line_blocks(spark, f"{tmp_path}/empty").collect() == []


def test_the_driver_keeps_no_files_of_a_tree(spark, monkeypatch, split, tmp_path):
    """Neither a list of them nor a task for each few of them."""
    from pyspark.sql import DataFrameReader

    from siftlake.workload import queries, tables

    rows = spark.range(1500).selectExpr("id AS doc_id", "concat('line ', id, '\n\nlast') AS text", "concat('src', id % 2) AS source")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    listed, read_text = [], DataFrameReader.text

    def text(self, *args, **options):
        df = read_text(self, *args, **options)
        listed.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(DataFrameReader, "text", text)
    split(1 << 20)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
    context, group = spark.sparkContext, f"tree-{tmp_path}"
    context.setJobGroup(group, "tree")
    try:
        found = queries.tree_line_blocks(spark, str(tmp_path))
        got = found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("s")).collect()
    finally:
        context.setJobGroup("other", "other")
    assert {(r.repo_id, r.n, r.s) for r in got} == {("repo=src0", 2250, 4500), ("repo=src1", 2250, 4500)}
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    most = max(info.numTasks for s in stages if (info := status.getStageInfo(s)))
    assert most < 200 and max(listed) < 10
