import random

from pyspark.sql import functions as F

from siftlake.operators import findings as FD, prefix
from siftlake.plans import report, scan
from siftlake.sources import corpus, tool_reports as TO

ROW = ("repo_id string, path string, line int, rank int, rule int, severity string, issue string, "
       "type string, code_snippet string, tool string, report_id long")


def finding(spark, rows):
    return spark.createDataFrame(rows, ROW)


def some(i, repo="r", path="a.py", issue="x", kind="security", severity="HIGH", tool="rules", rank=10):
    return (repo, path, i, rank, 0, severity, issue, kind, f"code {i}", tool, None)


def test_numbers_within_a_hot_key(spark):
    """One key with nine tenths of the rows is numbered across partitions."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(50)}", rng.randrange(10**9), i)
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, a long, b long").repartition(16)
    got = {(r.k, r.a, r.b): r.n for r in prefix.number_within(df, ["k"], ["a", "b"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, row in enumerate(sorted(r for r in rows if r[0] == key), 1):
            want[row] = n
    assert got == want


def test_size_budget_keeps_the_crossing_file(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(3)}" if i % 10 else "hot", f"p{i:05}", rng.randrange(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo_id string, path string, chars long").repartition(8)
    got = {(r.repo_id, r.path, r.before) for r in prefix.size_budget(df, 5000).collect()}
    want = set()
    for repo in {r[0] for r in rows}:
        total = 0
        for _, path, chars in sorted(r for r in rows if r[0] == repo):
            want.add((repo, path, total))
            total += chars
            if total > 5000:
                break
    assert got == want


def test_budget_of_exactly_the_limit_goes_on(spark):
    df = spark.createDataFrame([("r", "a", 5), ("r", "b", 5), ("r", "c", 1)], "repo_id string, path string, chars long")
    assert [r.path for r in prefix.size_budget(df, 10).orderBy("path").collect()] == ["a", "b", "c"]
    assert [r.path for r in prefix.size_budget(df, 9).orderBy("path").collect()] == ["a", "b"]


def test_size_limits(make_files):
    files = make_files([("r", "a.py", "x" * 20_000), ("r", "b.py", "é" * 10_001), ("r", "c.py", " \n"),
                        ("r", "d.md", "x"), ("r", "e.json", "x" * 100_001)])
    assert {r.path for r in corpus.payload_sizes(files).collect()} == {"a.py"}
    assert {r.path for r in corpus.payload_sizes(files, deep=True).collect()} == {"a.py", "b.py"}


def test_gates_and_fallback(spark, make_files):
    files = make_files([
        ("py", "a.py", "eval(x)\nif True:"), ("js", "a.js", "eval(x)\nif True:"),
        ("md", "a.md", "eval(x)"), ("covered", "a.py", "eval(x)\nif True:")])
    bandit = TO.ingest_bandit(spark.createDataFrame(
        [("covered", 1, '{"results":[{"filename":"/t/a.py","line_number":1,"issue_severity":"LOW","issue_text":"Bad"}]}'),
         ("py", 1, '{"results":[{"filename":"/t/a.py","line_number":1,"issue_severity":"LOW","issue_text":"An Import"}]}')],
        "repo_id string, report_id long, report string"), "/t")
    semgrep = TO.ingest_semgrep(spark.createDataFrame(
        [(r, 1, '{"results":[{"path":"/t/a","extra":{"severity":"error"}}]}') for r in ("py", "js", "md")],
        "repo_id string, report_id long, report string"), "/t")
    rows = scan.scan(files, bandit, semgrep).collect()
    got = {(r.repo_id, r.tool, r.type) for r in rows}
    assert ("py", "rules", "security") in got and ("py", "rules", "quality") in got
    assert not any(repo == "js" and kind in ("security", "quality") and tool == "rules" for repo, tool, kind in got)
    assert ("covered", "bandit", "security") in got and ("covered", "rules", "quality") in got
    assert ("covered", "rules", "security") not in got
    assert ("js", "semgrep", "security") in got and ("md", "semgrep", "security") not in got
    snippet = [r.code_snippet for r in rows if r.tool == "bandit"]
    assert snippet == ["eval(x)"]
    assert all(r.minimal_fix is None for r in rows if r.tool == "semgrep")


def test_not_seen(spark):
    left = finding(spark, [some(1), some(2), some(3, issue="y")])
    right = finding(spark, [some(1), some(3)])
    assert {(r.line, r.issue) for r in FD.not_seen(left, right).collect()} == {(2, "x"), (3, "y")}


def test_top_files_ties_go_to_the_first_seen(spark):
    from siftlake.operators.metrics import top_files

    rows = [some(i, path=f"{p}.py", rank=rank) for p, n, rank in
            (("a", 2, 20), ("b", 2, 10), ("c", 5, 80), ("d", 1, 10), ("e", 1, 20), ("f", 1, 10)) for i in range(n)]
    got = [(r.place, r.path) for r in top_files(finding(spark, rows)).orderBy("place").collect()]
    assert got == [(1, "c.py"), (2, "b.py"), (3, "a.py"), (4, "d.py"), (5, "f.py")]


def test_json_report_holds_every_issue_once(spark):
    import json

    rows = [some(i, repo="hot", path=f"p{i % 7}.py") for i in range(1, 60)] + [some(1, repo="one"), some(2, repo="unlisted"),
                                                                              some(3, repo=None)]
    found = FD.with_fix(finding(spark, rows))
    repos = spark.createDataFrame([("hot",), ("one",), ("none",)], "repo_id string")
    docs = {(r.repo_id, r.n): json.loads(r.report) for r in report.report_json(found, repos).collect()}
    assert sorted(k[1] for k in docs if k[0] == "hot") == list(range(60))
    order = [(docs["hot", n]["path"], docs["hot", n]["line"]) for n in range(1, 60)]
    assert order == sorted(order) and len(set(order)) == 59
    assert docs["hot", 0]["total_issues"] == docs["hot", 0]["security_issues"] == 59
    # no issue of a repository that the list of repositories lacks is lost
    assert docs["none", 0]["total_issues"] == 0 and docs["unlisted", 0]["total_issues"] == docs[None, 0]["total_issues"] == 1
    assert docs["unlisted", 1]["line"] == 2 and docs[None, 1]["line"] == 3 and len(docs) == 60 + 2 + 1 + 2 + 2


def test_json_documents_are_whole(spark, tmp_path):
    import json

    rows = [some(i, repo="hot", path=f"p{i % 7}.py") for i in range(1, 60)] + [some(1, repo="one")]
    found = FD.with_fix(finding(spark, rows))
    repos = spark.createDataFrame([("hot",), ("one",), ("none",)], "repo_id string")
    parts = report.report_json(found, repos)
    report.write_documents(report.json_documents(parts), str(tmp_path / "docs"))
    want = {r.repo_id: [] for r in parts.where("n = 0").collect()}
    for r in parts.where("n > 0").orderBy("n").collect():
        want[r.repo_id].append(json.loads(r.report))
    for repo, issues in want.items():
        files = sorted((tmp_path / "docs" / f"repo_id={repo}").glob("part-*"))
        document = json.loads("".join(f.read_text() for f in files))
        assert document["issues"] == issues and document["total_issues"] == len(issues) and document["repo_id"] == repo


def test_text_report_keeps_number_gaps(spark, tmp_path):
    rows = [some(1, issue="first"), some(2, issue=None), some(3, issue="  "), some(4, issue="last", severity=None)]
    repos = spark.createDataFrame([("r", "https://host/o/my-api")], "repo_id string, repo_url string")
    made = report.report_text(FD.with_fix(finding(spark, rows)), repos, "today")
    parts = made.orderBy("n").collect()
    text = "".join(p.text for p in parts)
    assert "1. [HIGH] first\n   File: a.py (Line 1)\n   Type: Security\n   Code: code 1\n   Fix: Fix: first\n\n" in text
    assert "\n4. [MEDIUM] last\n" in text and "\n2. " not in text and "\n3. " not in text
    assert text.startswith("COMPREHENSIVE SECURITY & QUALITY SCAN REPORT\n") and "Repository Type: api_service" in text
    assert [p.n for p in parts] == [0, 1, 4]
    report.write_report(made, str(tmp_path / "text"))
    files = sorted((tmp_path / "text").glob("part-*"))
    assert "".join(f.read_text() for f in files) == text


def test_numbers_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("k", 5)], "k string, a int")
    assert sorted((r.k or "", r.a, r.n) for r in prefix.number_within(df, ["k"], ["a"]).collect()) == [("", 1, 1), ("", 2, 2), ("k", 5, 1)]


def test_rows_of_a_repository_without_files_are_gated(spark, make_files):
    files = make_files([("r", "a.py", "x = 1")])
    bandit = TO.ingest_bandit(spark.createDataFrame(
        [("gone", 1, '{"results":[{"filename":"/t/a.py","line_number":1,"issue_severity":"LOW","issue_text":"Bad"}]}')],
        "repo_id string, report_id long, report string"), "/t")
    assert scan.scan(files, bandit).where("repo_id = 'gone'").count() == 0


def test_tool_findings_are_not_cut(spark, make_files):
    results = ",".join(f'{{"filename":"/t/a.py","line_number":{i},"issue_severity":"LOW","issue_text":"Bad"}}' for i in range(1, 41))
    bandit = TO.ingest_bandit(spark.createDataFrame([("r", 1, f'{{"results":[{results}]}}')],
                                                    "repo_id string, report_id long, report string"), "/t")
    rows = scan.scan(make_files([("r", "a.py", "\n".join(f"line {i}" for i in range(1, 60)))]), bandit).where("tool = 'bandit'").collect()
    assert {(r.line, r.code_snippet) for r in rows} == {(i, f"line {i}") for i in range(1, 41)}


def test_cap_is_per_repository(spark):
    rows = [("a", i // 3, i % 3) for i in range(30)] + [("b", 1, 0)]
    df = spark.createDataFrame(rows, "repo_id string, report_id long, rule int")
    got = TO.cap_findings(df).collect()
    assert {(r.report_id, r.rule) for r in got if r.repo_id == "a"} == {(i // 3, i % 3) for i in range(10)}
    assert len(got) == 11
