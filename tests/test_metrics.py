import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import findings as FD, metrics as M, structure
from tests.test_findings import finding, some


def repo_rows(repo, critical=0, high=0, medium=0, low=0, odd=0, kind="best_practice"):
    levels = ["CRITICAL"] * critical + ["HIGH"] * high + ["MEDIUM"] * medium + ["LOW"] * low + ["warning"] * odd
    return [some(i, repo=repo, kind=kind, severity=s) for i, s in enumerate(levels, 1)]


CASES = {
    # repository: (severities, risk, effort, compliance)
    "none": ({}, "LOW", "LOW (1-2 days)", "PASS"),
    "low5": ({"low": 5}, "LOW", "LOW (1-2 days)", "PASS"),
    "low6": ({"low": 6}, "MEDIUM", "LOW (1-2 days)", "PASS"),
    "low9": ({"low": 9}, "MEDIUM", "LOW (1-2 days)", "PASS"),
    "low10": ({"low": 10}, "MEDIUM", "MEDIUM (3-5 days)", "PASS"),
    "high2": ({"high": 2}, "LOW", "MEDIUM (3-5 days)", "PASS"),
    "high3": ({"high": 3}, "HIGH", "MEDIUM (3-5 days)", "FAIL"),
    "crit1": ({"critical": 1}, "CRITICAL", "LOW (1-2 days)", "FAIL"),
    "p24": ({"critical": 3}, "CRITICAL", "MEDIUM (3-5 days)", "FAIL"),
    "p25": ({"critical": 3, "odd": 1}, "CRITICAL", "HIGH (1-2 weeks)", "FAIL"),
    "p49": ({"critical": 6, "low": 1}, "CRITICAL", "HIGH (1-2 weeks)", "FAIL"),
    "p50": ({"critical": 5, "high": 2}, "CRITICAL", "VERY HIGH (2+ weeks)", "FAIL"),
}


def test_bands(spark):
    rows = [r for repo, (levels, *_) in CASES.items() for r in repo_rows(repo, **levels)]
    repos = spark.createDataFrame([(r,) for r in CASES], "repo_id string")
    counts = M.raw_counts(FD.with_fix(finding(spark, rows)), repos)
    got = {r.repo_id: (r.risk_level, r.remediation_effort, r.compliance_status)
           for r in M.metrics(counts).collect()}
    assert got == {repo: tuple(want) for repo, (_, *want) in CASES.items()}


@pytest.mark.parametrize("n,security,quality", [(0, 100, 100), (1, 85, 90), (6, 10, 40), (7, 0, 30), (11, 0, 0)])
def test_scores(spark, n, security, quality):
    rows = repo_rows("s", low=n, kind="security") + repo_rows("q", low=n, kind="quality")
    repos = spark.createDataFrame([("s",), ("q",)], "repo_id string")
    got = {r.repo_id: r for r in M.metrics(M.raw_counts(FD.with_fix(finding(spark, rows)), repos)).collect()}
    assert got["s"].security_score == security and got["q"].quality_score == quality
    assert got["s"].overall_score == round((security + 200) / 3, 1)
    assert got["q"].maintainability_index == max(0, 100 - 5 * n)


def test_breakdown_sums_to_the_total(spark):
    rows = repo_rows("r", critical=2, low=3) + [("r", None, 1, 30, 0, None, None, None, "", "semgrep", 1)]
    found = finding(spark, rows)
    got = {(r.dimension, r.value): r.issues for r in M.breakdown(found).collect()}
    assert got == {("type", "best_practice"): 5, ("type", "unknown"): 1, ("severity", "CRITICAL"): 2,
                   ("severity", "LOW"): 3, ("severity", "MEDIUM"): 1, ("file", "a.py"): 5, ("file", "unknown"): 1}
    for one, dim in ((M.by_type, "type"), (M.by_severity, "severity"), (M.by_file, "file")):
        assert one(found).agg(F.sum("issues")).first()[0] == 6


def test_density_and_coverage(spark):
    texts = ["85.5%", "85.5", "abc", None, "", " 7 %", "1e1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_coverage(F.col("t")).alias("c"))
    assert [r.c for r in rows.collect()] == [85.5, 85.5, 0, 0, 0, 7, 10]
    found = FD.with_fix(finding(spark, repo_rows("r", low=7)))
    cover = spark.createDataFrame([("r", 85.5)], "repo_id string, test_coverage double")
    assert M.metrics(M.raw_counts(found), cover).first().issue_density == round(7 / 8.55, 2)


def test_profile_language_and_names(spark):
    rows = ([some(1, repo="a", path="x.json")] + [some(1, repo="b", path="x.java")]
            + [some(i, repo="c", path="x.go") for i in range(10)])
    urls = spark.createDataFrame(
        [("a", "https://h/me/web-app.git"), ("b", "https://h/me/core"), ("c", "solo-lib")], "repo_id string, repo_url string")
    counts = M.raw_counts(FD.with_fix(finding(spark, rows)), urls)
    got = {r.repo_id: (r.name, r.owner, r.language, r.project_type, r.complexity) for r in M.repo_profile(counts).collect()}
    assert got == {"a": ("web-app", "me", "javascript", "web_application", "medium"),
                   "b": ("core", "me", "java", "application", "medium"),
                   "c": ("solo-lib", "unknown", "python", "library", "high")}


def test_recommendations_in_order(spark):
    rows = (repo_rows("r", critical=2, kind="security") + repo_rows("r", low=6, kind="quality")
            + [some(1, repo="r", issue="Dangerous filename with space"), some(2, repo="r", issue="not snake_case")])
    urls = spark.createDataFrame([("r", "u")], "repo_id string, repo_url string")
    got = M.recommendations(M.repo_profile(M.raw_counts(FD.with_fix(finding(spark, rows)), urls))).collect()
    assert [(r.position, r.priority) for r in got] == [(1, "CRITICAL"), (2, "HIGH"), (3, "HIGH"), (4, "MEDIUM")]
    assert got[0].description == "Fix 2 critical security issues immediately before deployment."


def test_scan_statistics(make_files):
    files = make_files([("r", p, "x") for p in (
        "a.py", "src/b.js", "src/core/c.go", ".git/hooks/h", "src/.x/y/z.py", "build/o.c", "docs/.hid", "venv/lib/k.py")]
        + [("empty", ".only", "x")])
    got = {r.repo_id: (r.files_scanned, r.directories_scanned) for r in structure.scan_stats(files).collect()}
    assert got == {"r": (3, 3), "empty": (0, 0)}
    assert {r.repo_id: r.code_files for r in structure.count_code_files(files).collect()} == {"r": 3, "empty": 0}


def test_accuracy(spark):
    s = spark.createDataFrame([("r", 10, 2, 1, 0, 0)],
                              "repo_id string, total_files long, python_files long, test_files long, main_files long, config_files long")
    counts = spark.createDataFrame([("r", 3)], "repo_id string, total_issues long")
    r = M.accuracy_metrics(s, counts).first()
    assert (r.detection_accuracy, r.false_positive_rate, r.scan_completeness) == (98.0, 2.0, 100.0)
    counts = spark.createDataFrame([("q", 3)], "repo_id string, total_issues long")
    s = spark.createDataFrame([("q", 0, 0, 0, 0, 0)], s.schema)
    r = M.accuracy_metrics(s, counts).first()
    assert (r.detection_accuracy, r.false_positive_rate, r.scan_completeness) == (90.0, 14.0, 66.0)
