import random

from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators.lines import annotated_lines, explode_lines
from siftlake.plans import scan
from siftlake.sources import corpus

from tests import brute


def test_comment_state_equals_fold(make_files):
    rng = random.Random(3)
    quote = ['"""', "'''", '"""a"""', "'''a'''", '"""\'\'\'', "'''\"\"\"", "x", "", '""""""', "a '''"]
    block = ["/*", "*/", "/* a */", "*/ /*", "x", "", "// /*", "end */"]
    rows = []
    for i in range(400):
        ext, marks = rng.choice([(".py", quote), (".rb", quote), (".js", block), (".go", block),
                                 (".txt", quote + block), (".sh", quote)])
        rows.append(("r", f"f{i}{ext}", "\n".join(rng.choice(marks) for _ in range(rng.randrange(30)))))
    got = {(r.path, r.line): r.masked for r in annotated_lines(make_files(rows)).collect()}
    for _, path, content in rows:
        lines = content.split("\n")
        for n, masked in enumerate(brute.masked_lines(lines, "." + path.rsplit(".")[-1]), 1):
            assert got[(path, n)] == masked, (path, n, lines)


def test_docstring_marks_equal_fold(make_files):
    rng = random.Random(5)
    parts = ["def a(x):", "  def b():", "class C:", '  """doc"""', "'''", "x = 1", "", "async def d():",
             "class  D(C): '''", "def e(): \"\"\"", "deff(a)", "\tdef  a (y):", "# TODO", "fixme now"]
    rows = [("r", f"f{i}.py", "\n".join(rng.choice(parts) for _ in range(rng.randrange(25))))
            for i in range(300)]
    found = scan.documentation_findings(make_files(rows)).collect()
    got = {(r.path, r.line, r.issue) for r in found if r.rule == 0}
    want, marks = set(), set()
    for _, path, content in rows:
        seen = set()
        for kind, line, name in brute.undocumented(content.split("\n")):
            issue = f"Missing docstring for {'function' if kind == 'F' else 'class'} {name}"
            if issue not in seen:
                seen.add(issue)
                want.add((path, line, issue))
        for n, line in enumerate(content.split("\n"), 1):
            marks |= {(path, n, w) for w in ("TODO", "FIXME") if w in line.upper()}
    assert got == want
    assert {(r.path, r.line, r.issue.split()[0]) for r in found if r.rule > 0} == marks


def test_line_counts_and_long_files(make_files):
    rows = [("r", "a.py", "x\n" * 500), ("r", "b.py", "x\n" * 501), ("r", "c.py", "x\n" * 500 + "x"),
            ("r", "e.py", "")]
    files = make_files(rows)
    assert {r.path: r["count"] for r in explode_lines(files).groupBy("path").count().collect()} == {
        "a.py": 501, "b.py": 502, "c.py": 501, "e.py": 1}
    iterated = explode_lines(files, iterate=True).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in iterated} == {"a.py": 500, "b.py": 501, "c.py": 501}
    long = scan.own_findings(files).where("issue LIKE 'File too long%'").collect()
    assert {(r.path, r.issue) for r in long} == {
        ("b.py", "File too long (501 lines) - consider splitting"),
        ("c.py", "File too long (501 lines) - consider splitting")}


def test_strip_equals_python(spark):
    import sys

    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = [f"{c}a{c}b{c}" for c in spaces] + ["", " ", "a", "​a​"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"))
    for r in rows.collect():
        assert r.s == r.t.strip(), repr(r.t)


def test_extension_equals_splitext(spark):
    import os

    paths = ["a.py", "x/.hidden", "x/.hidden.py", "a.b/c", "a.tar.gz", "..py", "x/...a", "a.", "noext", "d.d/.e.f"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.file_ext(F.col("p")).alias("e"))
    for r in rows.collect():
        assert r.e == os.path.splitext(r.p)[1], r.p


def test_read_tree(spark, tmp_path):
    (tmp_path / "repo1" / "src").mkdir(parents=True)
    (tmp_path / "repo1" / "src" / "a.py").write_bytes(b"a\r\nb\xff\rc")
    (tmp_path / "repo1" / "notes.md").write_text("x")
    (tmp_path / "repo2").mkdir()
    (tmp_path / "repo2" / "b.js").write_text("eval(x)")
    rows = corpus.read_tree(spark, str(tmp_path), (".py", ".js")).collect()
    assert {(r.repo_id, r.path, r.content) for r in rows} == {
        ("repo1", "src/a.py", "a\nb\nc"), ("repo2", "b.js", "eval(x)")}


def test_decode_text_equals_python(spark):
    raw = [b"abc", b"\xff\xfea", b"\xe2\x82", b"\xe2\x82\xac!", b"\xf0\x9f\x98", b"a\rb\r\nc", b"\xc3\xa9\xc3", b"\xed\xa0\x80x"]
    rows = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    got = [r.t for r in rows.select(T.decode_text(F.col("b")).alias("t")).collect()]
    assert got == [b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in raw]


def test_linear_mask_on_many_marks(make_files):
    """A file that is all marks, long enough for a quadratic method to be felt."""
    content = '"""\nx\n' * 100_000
    lines = annotated_lines(make_files([("r", "big.py", content)]))
    assert lines.where("masked").count() == 100_000


def test_the_written_tree_has_no_folder_per_file(spark, tmp_path):
    """A file lies in the folder of its repository and holds what Spark's own writer puts below a folder for each."""
    from pathlib import Path

    from siftlake.workload import tables

    rows = [(1, "a\nb", "src1"), (2, None, "src1"), (3, "caf\xe9\r\n", "a/b:c=d[e]^%"), (4, "", ""), (5, "x", None), (None, "y", "s p\t+{}"),
            (6, "twice", "src1"), (6, "twice", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    (docs.select(F.col("source").alias("repo"), F.col("doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("value"))
     .write.partitionBy("repo", "name").text(str(tmp_path / "folders")))
    root = tables.written_tree(spark, str(tmp_path))

    def found(at):
        files = corpus.read_tree(spark, at).select("repo_id", F.substring_index("path", "/", 1).alias("folder"), "content", "size_bytes")
        return sorted(map(repr, files.collect()))

    assert found(root) == found(str(tmp_path / "folders")) and len(found(root)) == 7
    assert not [d for d in Path(root.removeprefix("file:")).glob("*/*") if d.is_dir()]
