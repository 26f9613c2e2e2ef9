"""One findings table: de-duplication, gating and union of all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.functions.classify import minimal_fix
from siftlake.operators.dedup import dedup_hits

# Fixed order of a repository's findings.
ORDER = ("rank", "path", "line", "report_id", "rule")


def dedup_exact(findings: DataFrame) -> DataFrame:
    """E1."""
    return findings.dropDuplicates(["repo_id", "path", "line", "issue"])


def first_per_message(hits: DataFrame) -> DataFrame:
    """Lowest line per (path, message)."""
    return dedup_hits(hits.withColumn("dedup", F.lit(R.FIRST_PER_MESSAGE)))


def not_seen(extra: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``extra`` whose (path, line, issue) is not in ``seen``."""
    return extra.join(seen.select("repo_id", "path", "line", "issue"),
                      ["repo_id", "path", "line", "issue"], "left_anti")


def top_per_group(df: DataFrame, keys, order, limit: int, name: str = "rn") -> DataFrame:
    """First ``limit`` rows of each key.  Spark cuts each input partition to
    ``limit`` rows per key before the shuffle, so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def with_fix(findings: DataFrame) -> DataFrame:
    """Attach B8.  Findings of Pylint, Semgrep and the model carry none of ours."""
    ours = F.col("tool").isin("rules", "bandit")
    return findings.withColumn("minimal_fix", F.when(ours, minimal_fix(F.col("issue"), F.col("path"))))


def repo_gates(files: DataFrame) -> DataFrame:
    """per repository, whether it has Python files and any code files.  Reads
    paths only."""
    python = F.col("path").endswith(".py")
    other = T.has_extension(F.col("path"), R.OTHER_LANGUAGE_EXTENSIONS)
    return files.groupBy("repo_id").agg(
        F.bool_or(python).alias("has_python"), F.bool_or(python | other).alias("has_code"))


def gate_by_language(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """security and quality rules need a Python file, Semgrep any code file.
    F2 as well when ``gates`` says which repositories a linter covers."""
    security = F.col("rank").isin(R.RANKS["security"], R.RANKS["advanced"])
    quality = F.col("rank") == R.RANKS["quality"]
    semgrep = F.col("rank") == R.RANKS["semgrep"]
    has_python, has_code = (F.coalesce(c, F.lit(False)) for c in ("has_python", "has_code"))  # no file at all
    drop = ((security | quality) & ~has_python) | (semgrep & ~has_code)
    if "covers_security" in gates.columns:
        own = F.col("tool") == "rules"
        drop = drop | (own & security & F.col("covers_security")) | (own & quality & F.col("covers_quality"))
    rows = findings.join(gates, "repo_id", "left").where(~F.coalesce(drop, F.lit(False)))
    return rows.drop(*[c for c in gates.columns if c != "repo_id"])


def linter_cover(linters: DataFrame) -> DataFrame:
    """which repositories have rows of a security or a quality linter."""
    return linters.groupBy("repo_id").agg(
        F.bool_or(F.col("rank") == R.RANKS["security"]).alias("covers_security"),
        F.bool_or(F.col("rank") == R.RANKS["quality"]).alias("covers_quality"))


def tool_or_rules(tool_rows: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """per repository the tool's rows, or the rule rows when the tool has none."""
    with_tool = tool_rows.select("repo_id").distinct()
    return tool_rows.unionByName(
        rule_rows.join(with_tool, "repo_id", "left_anti"), allowMissingColumns=True)
