"""One row per (path, line, message), or the first line per (path, message), over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlake import rules as R


def dedup_hits(hits: DataFrame, *more: str) -> DataFrame:
    """E1/E2 for hits that lie in several tasks: one aggregate with map-side combine.  Hits of whole
    files need it not, as they are unique on the row of the file.  ``more`` are columns to keep that
    the kind of hit decides."""
    per_line = F.when(F.col("dedup") == R.ONCE_PER_LINE, F.col("line"))
    return (
        hits.groupBy("repo_id", "path", "rank", "type", "issue", *more, per_line.alias("per_line"))
        .agg(F.min("line").alias("line"),
             F.min_by(F.struct("rule", "severity", "code_snippet"), "line").alias("first"))
        .select("repo_id", "path", "line", "rank", "first.rule", "first.severity", "issue", "type", *more,
                "first.code_snippet")
    )
