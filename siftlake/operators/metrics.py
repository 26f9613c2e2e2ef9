"""Counts, scores and assessments per repository.

Everything here is conditional aggregation, which combines on the map side, so a
repository with a large share of the findings costs its reducer one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.classify import (
    OTHER_AREA, QUALITY_AREAS, SECURITY_AREAS, quality_area, security_area)
from siftlake.functions.text import contains_any

# Fixed values.
ISSUE_TYPES = ("security", "quality", "performance", "best_practice", "maintainability",
               "documentation", "accessibility", "testability")
EFFORT_POINTS = {"CRITICAL": 8, "HIGH": 5, "MEDIUM": 3}
EFFORT_BANDS = ((10, "LOW (1-2 days)"), (25, "MEDIUM (3-5 days)"), (50, "HIGH (1-2 weeks)"))
EFFORT_TOP = "VERY HIGH (2+ weeks)"
IMPACTS = {
    "CRITICAL": ("HIGH - Potential security breaches and system failures",
                 "DO NOT DEPLOY - Fix critical issues first", "Immediate action required"),
    "HIGH": ("MEDIUM - Quality and security concerns may affect reliability",
             "DEPLOY WITH CAUTION - Plan fixes in next sprint", "Address within 1 week"),
}
IMPACT_OTHER = ("LOW - Minor improvements needed",
                "SAFE TO DEPLOY - Address issues in maintenance cycle", "Address within 1 month")
SECTIONS = {
    "performance": "performance",
    "best_practice": "best_practices", "maintainability": "best_practices",
    "documentation": "documentation", "accessibility": "documentation",
    "testability": "documentation",
}
PROJECT_TYPES = ((("api", "service"), "api_service"), (("web", "frontend"), "web_application"),
                 (("lib", "package"), "library"))
PROJECT_OTHER = "application"

# What stands for a missing value in a breakdown.
_TYPE = "coalesce(type, 'unknown')"
_SEVERITY = "coalesce(severity, 'MEDIUM')"
_FILE = "coalesce(path, 'unknown')"


def _count(group, name):
    return group.agg(F.count("*").alias(name))


def by_type(findings: DataFrame) -> DataFrame:
    """G1."""
    return _count(findings.groupBy("repo_id", F.expr(_TYPE).alias("type")), "issues")


def by_severity(findings: DataFrame) -> DataFrame:
    """G2."""
    return _count(findings.groupBy("repo_id", F.expr(_SEVERITY).alias("severity")), "issues")


def by_file(findings: DataFrame) -> DataFrame:
    """G3."""
    return _count(findings.groupBy("repo_id", F.expr(_FILE).alias("path")), "issues")


def breakdown(findings: DataFrame) -> DataFrame:
    """G1 to G3 from one read: rows (repo_id, dimension, value, issues)."""
    dims = findings.select("repo_id", F.expr(
        f"explode(map('type', {_TYPE}, 'severity', {_SEVERITY}, 'file', {_FILE}))")
        .alias("dimension", "value"))
    return _count(dims.groupBy("repo_id", "dimension", "value"), "issues")


def top_files(findings: DataFrame, limit: int = 5) -> DataFrame:
    """Files with most findings; ties by first appearance in the report."""
    from siftlake.operators.findings import top_per_group

    files = findings.groupBy("repo_id", F.expr(_FILE).alias("path")).agg(
        F.count("*").alias("issues"), F.min("rank").alias("first_rank"))
    top = top_per_group(files, ["repo_id"], [F.desc("issues"), "first_rank", "path"], limit, "place")
    return top.select("repo_id", "place", "path", "issues")


def raw_counts(findings: DataFrame, repos: DataFrame | None = None, areas: bool = False) -> DataFrame:
    """G4 and what the scores, effort, profile and recommendations need: one pass,
    one row per repository.  ``repos`` adds repositories without findings; those of
    findings that it lacks stay.  ``areas`` adds the counts of B11 and B12."""
    points = " ".join(f"WHEN '{s}' THEN {p}" for s, p in EFFORT_POINTS.items())
    counters = {"total_issues": "count(*)"}
    counters.update({f"{t}_issues": f"count_if(type = '{t}')" for t in ISSUE_TYPES})
    counters.update({f"{s.lower()}_issues": f"count_if(severity = '{s}')"
                     for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")})
    counters.update({
        "critical_security": "count_if(type = 'security' AND severity = 'CRITICAL')",
        "filename_issues": "count_if(contains(lower(issue), 'filename'))",
        "snake_case_issues": "count_if(contains(lower(issue), 'snake_case'))",
        "js_paths": "count_if(contains(path, '.js'))",
        "java_paths": "count_if(contains(path, '.java'))",
        "fixes": "count_if(minimal_fix IS NOT NULL)",
        "effort_points": f"sum(CASE {_SEVERITY} {points} ELSE 1 END)",
    })
    aggregates = [F.expr(f"{how} AS {name}") for name, how in counters.items()]
    if areas:
        findings = findings.withColumns({"_security": security_area(F.col("issue")), "_quality": quality_area(F.col("issue"))})
        aggregates += [F.count_if((F.col("type") == kind) & (F.col(f"_{kind}") == n)).alias(f"{kind}_area_{n}")
                       for kind, table in (("security", SECURITY_AREAS), ("quality", QUALITY_AREAS))
                       for n in [*(n for n, _ in table), OTHER_AREA]]
    counts = findings.groupBy("repo_id").agg(*aggregates)
    if repos is not None:
        counts = repos.join(counts, "repo_id", "full").fillna(0)
    return counts


def scores(counts: DataFrame) -> DataFrame:
    """G5."""
    def score(kind, weight):
        return F.greatest(F.lit(0), 100 - F.col(f"{kind}_issues") * weight)

    rows = counts.withColumns({
        "security_score": score("security", 15), "quality_score": score("quality", 10),
        "performance_score": score("performance", 10)})
    total = F.col("security_score") + F.col("quality_score") + F.col("performance_score")
    return rows.withColumn("overall_score", F.round(total / 3, 1))


def risk_level() -> Column:
    """G6."""
    return (F.when(F.col("critical_issues") > 0, "CRITICAL").when(F.col("high_issues") > 2, "HIGH")
            .when(F.col("total_issues") > 5, "MEDIUM").otherwise("LOW"))


def remediation_effort() -> Column:
    """G7."""
    band = F.lit(EFFORT_TOP)
    for limit, name in reversed(EFFORT_BANDS):
        band = F.when(F.col("effort_points") < limit, name).otherwise(band)
    return band


def compliance() -> Column:
    """G8."""
    return F.when((F.col("critical_issues") == 0) & (F.col("high_issues") < 3), "PASS").otherwise("FAIL")


def issue_density(coverage: Column) -> Column:
    """G9."""
    return F.round(F.col("total_issues") / F.greatest(F.lit(1.0), coverage / 10), 2)


def maintainability_index() -> Column:
    """G13."""
    return F.greatest(F.lit(0), 100 - F.col("quality_issues") * 5)


def executive_summary() -> Column:
    """Needs the metrics columns."""
    total, security = F.col("total_issues").cast("string"), F.col("security_issues").cast("string")
    head = (
        F.when(F.col("risk_level") == "CRITICAL", F.concat(
            F.lit("CRITICAL SECURITY RISKS DETECTED: "), security,
            F.lit(" security vulnerabilities found requiring immediate attention.")))
        .when(F.col("risk_level") == "HIGH", F.concat(
            F.lit("HIGH RISK: "), total,
            F.lit(" issues identified with significant security and quality concerns.")))
        .when(F.col("risk_level") == "MEDIUM", F.concat(
            F.lit("MODERATE RISK: "), total,
            F.lit(" issues found with manageable security and quality improvements needed.")))
        .otherwise(F.concat(
            F.lit("LOW RISK: "), total,
            F.lit(" minor issues identified. Overall code quality is acceptable."))))
    return F.concat(head, F.lit(" Overall security score: "), F.col("security_score").cast("string"),
                    F.lit("/100. Estimated remediation effort: "), F.col("remediation_effort"),
                    F.lit("."))


def impact() -> Column:
    """Business impact, deployment advice and timeline."""
    names = ("business_impact", "deployment_recommendation", "timeline")

    def texts(values):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    chain = None
    for risk, values in IMPACTS.items():
        test = F.col("risk_level") == risk
        chain = F.when(test, texts(values)) if chain is None else chain.when(test, texts(values))
    return chain.otherwise(texts(IMPACT_OTHER))


def metrics(counts: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """G5 to G9 and G13 on one row per repository.  ``coverage`` is (repo_id,
    test_coverage)."""
    if coverage is None:
        rows = counts.withColumn("test_coverage", F.lit(0.0))
    else:
        rows = counts.join(coverage, "repo_id", "left").fillna(0.0, ["test_coverage"])
    return scores(rows).withColumns({
        "risk_level": risk_level(),
        "issue_density": issue_density(F.col("test_coverage")),
        "remediation_effort": remediation_effort(),
        "compliance_status": compliance(),
        "maintainability_index": maintainability_index(),
    })


def accuracy_metrics(structure: DataFrame, counts: DataFrame) -> DataFrame:
    """From the file roles and the number of findings."""
    python = F.greatest(F.lit(1), F.col("python_files"))
    rows = structure.join(counts.select("repo_id", "total_issues"), "repo_id", "left").fillna(0)
    depth, density = F.col("depth"), F.col("density")
    return rows.withColumns({
        "depth": F.least(F.lit(100.0), F.col("total_files") / python * 20),
        "density": F.col("total_issues") / python,
    }).select(
        "repo_id", F.col("total_files").alias("files_analyzed"),
        F.col("python_files").alias("code_files"), "test_files",
        F.least(F.lit(98.0), 75.0 + depth + density * 5).alias("detection_accuracy"),
        F.greatest(F.lit(2.0), 20.0 - depth - density * 2).alias("false_positive_rate"),
        F.least(F.lit(100.0), 60.0 + depth + F.col("total_issues") * 2).alias("scan_completeness"))


def repo_profile(counts: DataFrame) -> DataFrame:
    """Needs ``repo_url`` beside the counts."""
    parts = F.split(F.replace("repo_url", F.lit(".git"), F.lit("")), "/")
    name = F.element_at(parts, -1)
    kind = F.lit(PROJECT_OTHER)
    for words, value in reversed(PROJECT_TYPES):
        kind = F.when(contains_any(F.lower(name), words), value).otherwise(kind)
    return counts.withColumns({
        "name": name,
        "owner": F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("unknown"),
        "language": F.when(F.col("js_paths") > 0, "javascript")
        .when(F.col("java_paths") > 0, "java").otherwise("python"),
        "project_type": kind,
        "complexity": F.when(F.col("total_issues") < 10, "medium").otherwise("high"),
    })


def _areas(findings, kind, area, names, prefix):
    return findings.where(F.col("type") == kind).withColumn("area", area).groupBy("repo_id").agg(
        *[F.count_if(F.col("area") == n).alias(f"{prefix}{n}") for n in names])


def security_areas(findings: DataFrame, prefix: str = "") -> DataFrame:
    """Security findings per area."""
    names = [n for n, _ in SECURITY_AREAS] + [OTHER_AREA]
    return _areas(findings, "security", security_area(F.col("issue")), names, prefix)


def quality_areas(findings: DataFrame, prefix: str = "") -> DataFrame:
    """Quality findings per area."""
    names = [n for n, _ in QUALITY_AREAS] + [OTHER_AREA]
    return _areas(findings, "quality", quality_area(F.col("issue")), names, prefix)


def trend(counts: DataFrame) -> DataFrame:
    """G17."""
    common = F.when(F.col("quality_issues") > F.col("security_issues"), "quality").otherwise("security")
    return counts.select("repo_id", common.alias("most_common_issue_type"),
                         *[F.col(f"{s}_issues").alias(s) for s in ("critical", "high", "medium", "low")])


def recommendation_array() -> Column:
    """Up to four structs in order; needs counts and language."""
    def row(test, priority, category, title, description, effort):
        texts = (priority, category, title, description, effort)
        names = ("priority", "category", "title", "description", "effort")
        return F.when(test, F.struct(*[
            (t if isinstance(t, Column) else F.lit(t)).alias(n) for t, n in zip(texts, names)]))

    return F.array_compact(F.array(
        row(F.col("critical_security") > 0, "CRITICAL", "Security",
            "Address Critical Security Vulnerabilities",
            F.concat(F.lit("Fix "), F.col("critical_security").cast("string"),
                     F.lit(" critical security issues immediately before deployment.")), "HIGH"),
        row(F.col("quality_issues") > 5, "HIGH", "Code Quality", "Improve Code Quality Standards",
            F.concat(F.lit("Address "), F.col("quality_issues").cast("string"),
                     F.lit(" quality issues to improve maintainability.")), "MEDIUM"),
        row(F.col("filename_issues") > 0, "HIGH", "Infrastructure", "Fix File Naming Issues",
            "Rename files with spaces/accents to prevent deployment issues on Linux systems.", "LOW"),
        row((F.col("language") == "python") & (F.col("snake_case_issues") > 0), "MEDIUM",
            "Python Standards", "Follow Python Naming Conventions",
            "Use snake_case for functions and PascalCase for classes as per PEP 8.", "LOW"),
    ))


def recommendations(profiles: DataFrame) -> DataFrame:
    """One row per recommendation."""
    return profiles.select(
        "repo_id", F.posexplode(recommendation_array()).alias("pos", "r")).select(
        "repo_id", (F.col("pos") + 1).alias("position"), "r.*")


def _section() -> Column:
    return F.element_at(F.map_from_arrays(F.lit(list(SECTIONS)), F.lit(list(SECTIONS.values()))),
                        F.col("type"))


def assessment_findings(findings: DataFrame) -> DataFrame:
    """G21, the lists: findings with the report section they belong to."""
    return findings.withColumn("section", _section()).where(F.col("section").isNotNull())


def assessment_rollup(findings: DataFrame) -> DataFrame:
    """G21, the counts."""
    return assessment_findings(findings).groupBy("repo_id", "section", "type").agg(
        F.count("*").alias("issues"))
