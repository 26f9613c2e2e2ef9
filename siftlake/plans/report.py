"""Reports per repository as JSON or text, in rows.

A report of a very large repository cannot be one value: it is the rows of its repository in the
order of ``n``, row 0 being the head and row n the n-th issue, whatever the size.  The writers put
them below each other in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.operators import metrics as M
from siftlake.operators.findings import ORDER
from siftlake.operators.prefix import number_within

ISSUE_FIELDS = ("path", "line", "severity", "issue", "type", "code_snippet", "minimal_fix")
COUNTERS = tuple(f"{t}_issues" for t in M.ISSUE_TYPES)


def numbered(findings: DataFrame) -> DataFrame:
    """Issue numbers ``n`` in report order, also for a repository of any size."""
    return number_within(findings, ["repo_id"], ORDER)


def drop_empty_issues(findings: DataFrame) -> DataFrame:
    """C7."""
    return findings.where(F.trim(F.coalesce("issue", F.lit(""))) != "")


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def report_json(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """A10: (repo_id, n, report): the counters by type in row 0, then an issue a row."""
    rows = numbered(findings)  # also the cut that the counts read
    heads = M.raw_counts(rows, repos).select(
        "repo_id", F.lit(0).cast("long").alias("n"), _json("repo_id", "total_issues", *COUNTERS).alias("report"))
    return heads.unionByName(rows.select("repo_id", F.col("n").cast("long").alias("n"), _json(*ISSUE_FIELDS).alias("report")))


def json_documents(rows: DataFrame) -> DataFrame:
    """(repo_id, n, text) from the rows of :func:`report_json`: put below each other in the order of
    ``n``, the texts of a repository are one JSON document, its counters and then its ``issues``.  The
    row behind the last issue closes it, so a document may have any size."""
    heads, issues = rows.where("n = 0"), rows.where("n > 0")
    open_ = F.concat(F.left("report", F.char_length("report") - 1), F.lit(',"issues":['))
    last = F.get_json_object("report", "$.total_issues").cast("long") + 1
    return (heads.select("repo_id", "n", open_.alias("text"))
            .unionByName(issues.select("repo_id", "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "report").alias("text")))
            .unionByName(heads.select("repo_id", last.alias("n"), F.lit("]}").alias("text"))))


def write_documents(rows: DataFrame, path: str) -> None:
    """A folder ``repo_id=…`` for each repository; its files, one after another, are its document."""
    (rows.repartitionByRange("repo_id", "n").sortWithinPartitions("repo_id", "n").select("repo_id", F.col("text").alias("value"))
     .write.partitionBy("repo_id").text(path))


def write_report(rows: DataFrame, path: str) -> None:
    """Sink of A10 and A11: the rows of ``report_json`` (as JSON lines) or of a text report, one
    repository after another, each in order; a large one covers several files, in their order."""
    text = F.regexp_replace(F.col([c for c in rows.columns if c in ("report", "text")][0]), r"\n\z", "")
    rows.orderBy("repo_id", "n").select(text.alias("value")).write.text(path)


def _lines(*parts) -> Column:
    """Text parts, one below the other; a part is text or a column."""
    cells = []
    for part in parts:
        cells += [part if isinstance(part, Column) else F.lit(part), F.lit("\n")]
    return F.concat(*cells)


def _value(label: str, name: str, suffix: str = "") -> Column:
    return F.concat(F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(suffix))


def _area_lines(prefix: str, names) -> Column:
    """Only areas with findings."""
    shown = [F.when(F.col(f"{prefix}{n}") > 0, F.concat(
        F.lit(f"• {n.title()}: "), F.col(f"{prefix}{n}").cast("string"), F.lit(" issues\n")))
        for n in names]
    return F.concat(*[F.coalesce(s, F.lit("")) for s in shown])


def _recommendation_lines() -> Column:
    rows = F.transform("recommendations", lambda r, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), r["priority"], F.lit("] "), r["title"],
        F.lit("\n   Category: "), r["category"], F.lit("\n   Description: "), r["description"],
        F.lit("\n   Effort: "), r["effort"], F.lit("\n\n")))
    return F.array_join(rows, "")



# Headings of the text report.
TITLE = ("COMPREHENSIVE SECURITY & QUALITY SCAN REPORT", "=============================================")
REPOSITORY = ("REPOSITORY INFORMATION", "---------------------")
SUMMARY = ("EXECUTIVE SUMMARY", "----------------")
METRICS = ("KEY METRICS", "-----------")
SECURITY = ("SECURITY ASSESSMENT", "------------------")
QUALITY = ("QUALITY ASSESSMENT", "-----------------")
PERFORMANCE = ("PERFORMANCE ASSESSMENT", "---------------------")
PRACTICES = ("BEST PRACTICES & MAINTAINABILITY", "-------------------------------")
ADDITIONAL = ("ADDITIONAL ASSESSMENTS", "---------------------")
RECOMMENDATIONS = ("RECOMMENDATIONS", "---------------")
ISSUES = ("DETAILED ISSUES", "---------------")


def report_header(facts: DataFrame, as_of: str) -> Column:
    """Everything above the issues.  ``facts`` has one row per repository."""
    security = [n for n, _ in M.SECURITY_AREAS] + [M.OTHER_AREA]
    quality = [n for n, _ in M.QUALITY_AREAS] + [M.OTHER_AREA]
    # a missing coverage is the whole number 0
    coverage = F.when(F.col("test_coverage") == 0, "0").otherwise(F.col("test_coverage").cast("string"))
    return F.concat(
        _lines(*TITLE, "", *REPOSITORY, _value("Repository: ", "repo_url"),
               _value("Scan ID: ", "scan_id"), f"Scan Date: {as_of}",
               _value("Repository Type: ", "project_type"), _value("Primary Language: ", "language"),
               "", *SUMMARY, F.col("executive_summary"), "", *METRICS,
               _value("Overall Score: ", "overall_score", "/100"),
               _value("Security Score: ", "security_score", "/100"),
               _value("Quality Score: ", "quality_score", "/100"),
               _value("Performance Score: ", "performance_score", "/100"),
               _value("Risk Level: ", "risk_level"),
               F.concat(F.lit("Test Coverage: "), coverage, F.lit("%")),
               _value("Compliance Status: ", "compliance_status"),
               _value("Remediation Effort: ", "remediation_effort"), "", *SECURITY,
               _value("Total Security Issues: ", "security_issues"),
               _value("Security Score: ", "security_score", "/100"),
               _value("Compliance Status: ", "compliance_status"), "", "Security Categories:"),
        _area_lines("security_area_", security),
        _lines("", "", *QUALITY, _value("Total Quality Issues: ", "quality_issues"),
               _value("Quality Score: ", "quality_score", "/100"),
               _value("Maintainability Index: ", "maintainability_index", "/100"), "",
               "Quality Categories:"),
        _area_lines("quality_area_", quality),
        _lines("", *PERFORMANCE, _value("Total Performance Issues: ", "performance_issues"),
               _value("Performance Score: ", "performance_score", "/100"), "", *PRACTICES,
               _value("Best Practice Issues: ", "best_practice_issues"),
               _value("Maintainability Issues: ", "maintainability_issues"), "", *ADDITIONAL,
               _value("Documentation Issues: ", "documentation_issues"),
               _value("Accessibility Issues: ", "accessibility_issues"),
               _value("Testability Issues: ", "testability_issues"), "", *RECOMMENDATIONS),
        _recommendation_lines(),
        _lines("", *ISSUES),
    )


def issue_block() -> Column:
    """One numbered issue of the text report."""
    title = F.replace(F.initcap(F.replace("type", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))
    code = F.when(F.col("code_snippet") != "",
                  F.concat(F.lit("   Code: "), F.col("code_snippet"), F.lit("\n")))
    fix = F.when(F.col("minimal_fix").isNotNull(),
                 F.concat(F.lit("   Fix: "), F.col("minimal_fix.suggestion"), F.lit("\n")))
    none = F.lit("")
    return F.concat(
        F.col("n").cast("string"), F.lit(". ["), F.coalesce("severity", F.lit("MEDIUM")), F.lit("] "),
        F.col("issue"), F.lit("\n   File: "), F.coalesce("path", none), F.lit(" (Line "),
        F.coalesce(F.col("line").cast("string"), none), F.lit(")\n   Type: "),
        F.coalesce(title, none), F.lit("\n"),
        F.coalesce(code, F.lit("")), F.coalesce(fix, F.lit("")), F.lit("\n"))


def repository_facts(findings: DataFrame, repos: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row per repository with all metrics, areas, profile and recommendations.
    ``repos`` is (repo_id, repo_url)."""
    rows = M.repo_profile(M.metrics(M.raw_counts(findings, repos, areas=True), coverage))
    return rows.withColumns({
        "executive_summary": M.executive_summary(), "recommendations": M.recommendation_array()})


def report_text(findings: DataFrame, repos: DataFrame, as_of: str, coverage: DataFrame | None = None) -> DataFrame:
    """(repo_id, n, text).  Issues are numbered before empty ones are left
    out, so their numbers leave gaps.  The header is row 0."""
    rows = numbered(findings)  # also the cut that the header reads
    facts = repository_facts(rows, repos, coverage).withColumn("scan_id", F.col("repo_id"))
    heads = facts.select("repo_id", F.lit(0).cast("long").alias("n"), report_header(facts, as_of).alias("text"))
    return heads.unionByName(drop_empty_issues(rows).select(
        "repo_id", F.col("n").cast("long").alias("n"), issue_block().alias("text")))


def basic_report_text(findings: DataFrame, repos: DataFrame, as_of: str) -> DataFrame:
    """A11 without metrics: the short form."""
    rows = numbered(findings)
    header = _lines(
        "BASIC SCAN REPORT", "=================", "", _value("Repository: ", "repo_url"),
        _value("Job ID: ", "repo_id"), f"Completed: {as_of}", "", "SUMMARY", "-------",
        _value("Total Issues: ", "total_issues"), _value("Security Issues: ", "security_issues"),
        _value("Quality Issues: ", "quality_issues"), "", *ISSUES)
    heads = M.raw_counts(rows, repos).select("repo_id", F.lit(0).cast("long").alias("n"), header.alias("text"))
    none = F.lit("")
    code = F.when(F.col("code_snippet") != "",
                  F.concat(F.lit("   Code: "), F.col("code_snippet"), F.lit("\n")))
    block = F.concat(
        F.col("n").cast("string"), F.lit(". "), F.upper(F.coalesce("type", none)), F.lit(": "),
        F.col("issue"), F.lit("\n   File: "), F.coalesce("path", none), F.lit(" (Line "),
        F.coalesce(F.col("line").cast("string"), none), F.lit(")\n   Severity: "),
        F.coalesce("severity", none), F.lit("\n"), F.coalesce(code, none), F.lit("\n"))
    return heads.unionByName(drop_empty_issues(rows).select(
        "repo_id", F.col("n").cast("long").alias("n"), block.alias("text")))
