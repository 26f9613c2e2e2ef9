"""The scan plan: files in, findings out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siftlake import rules as R
from siftlake.operators import findings as FD
from siftlake.operators.metrics import raw_counts
from siftlake.operators.structure import scan_stats
from siftlake.operators.matching import DOCUMENTATION, line_hits
from siftlake.session import cut
from siftlake.sources.tool_reports import snippet_lookup


def rule_findings(files: DataFrame, *groups: R.RuleGroup, giant_bytes: int | None = None) -> DataFrame:
    """Findings of single rule groups."""
    return line_hits(files, groups, giant_bytes=giant_bytes).drop("dedup")


def documentation_findings(files: DataFrame, kinds=DOCUMENTATION, giant_bytes: int | None = None) -> DataFrame:
    """D9 to D11, or some of them."""
    hits = line_hits(files.where(F.col("path").endswith(".py")), documentation=kinds, giant_bytes=giant_bytes)
    return hits.drop("dedup")


def own_findings(files: DataFrame, giant_bytes: int | None = None) -> DataFrame:
    """All analysers in one pass over the corpus.  A path stands for one file: findings are unique on
    its row, so nothing is shuffled."""
    hits = line_hits(files, R.ALL_GROUPS, filenames=True, long_files=True, documentation=DOCUMENTATION, giant_bytes=giant_bytes)
    return hits.drop("dedup").withColumns({
        "tool": F.lit("rules"), "report_id": F.lit(None).cast("long")})


def scan(files: DataFrame, linters: DataFrame | None = None, semgrep: DataFrame | None = None,
         model: DataFrame | None = None, giant_bytes: int | None = None) -> DataFrame:
    """the combined findings of all sources, gated per repository.

    The tables are outputs of ``siftlake.sources.tool_reports``; ``linters`` holds the
    rows of Bandit and Pylint, which replace our rules where they have any."""
    rows, gates = own_findings(files, giant_bytes), FD.repo_gates(files)
    quoting = [t for t in (linters, model) if t is not None]
    if quoting:
        # written once: the reports are parsed once for cover, hashes and rows
        named = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), quoting), "named")
        gates = gates.join(FD.linter_cover(named), "repo_id", "left").fillna(
            False, ["covers_security", "covers_quality"])
        rows = rows.unionByName(snippet_lookup(named, files), allowMissingColumns=True)
    if semgrep is not None:
        rows = rows.unionByName(semgrep, allowMissingColumns=True)
    # one row per repository: written out, its size is known, and Spark broadcasts it
    # when it is small instead of shuffling all findings by repository
    return FD.with_fix(FD.gate_by_language(rows, cut(gates, "gates")))


def scan_rows(files: DataFrame, findings: DataFrame, repos: DataFrame, as_of: str) -> DataFrame:
    """The rows that a finished scan writes to the scan table: one per repository, with
    its counters.  The findings stay a table of their own; ``repos`` is (repo_id,
    repo_url, user_id) and the job is named after the repository and the time."""
    at = F.lit(as_of).cast("timestamp_ntz")
    rows = repos.join(scan_stats(files), "repo_id", "left").join(
        raw_counts(findings).select("repo_id", "total_issues", "security_issues", "quality_issues"),
        "repo_id", "left").fillna(0, ["total_issues", "security_issues", "quality_issues",
                                      "files_scanned", "directories_scanned"])
    return rows.select(
        F.concat_ws("@", "repo_id", F.lit(as_of)).alias("job_id"), "user_id", "repo_url",
        F.lit("completed").alias("status"), "total_issues", "security_issues", "quality_issues",
        "files_scanned", "directories_scanned", at.alias("created_at"), at.alias("updated_at"),
        at.alias("completed_at"))
