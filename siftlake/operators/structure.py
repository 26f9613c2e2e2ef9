"""Repository statistics from file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.sources.corpus import prune_dirs, visible

# Fixed values.
MAIN_MODULES = ("main.py", "app.py", "__init__.py", "run.py")
ESSENTIAL = ("main.py", "app.py", "__init__.py", "requirements.txt")
REMOVABLE = ("test_", "demo_", "example_", "backup_")
MANY_PYTHON, MANY_PYTHON_ADVICE = 5, "Consider consolidating into fewer files"
MANY_CONFIG, MANY_CONFIG_ADVICE = 3, "Minimize configuration files"
STANDING_ADVICE = (
    "Keep only essential dependencies in requirements.txt",
    "Use single main.py file for simple projects",
    "Avoid deep directory nesting",
    "Remove unused imports and functions",
)


def repositories(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct()


def directories(files: DataFrame, names=R.IGNORED_DIRS) -> DataFrame:
    """Distinct visible directories, from the parents of all files.  Parents are made
    distinct before their ancestors are listed."""
    parents = files.select("repo_id", F.split("path", "/").alias("parts")).select(
        "repo_id", F.slice("parts", 1, F.size("parts") - 1).alias("parts")).distinct()
    depth = F.explode(F.sequence(F.lit(1), F.size("parts")))
    return (
        parents.where(F.size("parts") > 0).select("repo_id", "parts", depth.alias("depth"))
        .select("repo_id", F.slice("parts", 1, F.col("depth")).alias("parts"))
        .where(~F.exists("parts", lambda d: d.startswith(".") | d.isin(*names)))
        .select("repo_id", F.array_join("parts", "/").alias("directory")).distinct()
    )


def scan_stats(files: DataFrame) -> DataFrame:
    """Visible files and directories of each repository."""
    n_files = visible(files).groupBy("repo_id").agg(F.count("*").alias("files_scanned"))
    n_dirs = directories(files).groupBy("repo_id").agg(F.count("*").alias("directories_scanned"))
    return (repositories(files).join(n_files, "repo_id", "left").join(n_dirs, "repo_id", "left")
            .fillna(0, ["files_scanned", "directories_scanned"]))


def count_code_files(files: DataFrame) -> DataFrame:
    """G12."""
    counted = prune_dirs(files, R.IGNORED_DIRS).groupBy("repo_id").agg(
        F.count_if(T.has_extension(F.col("path"), R.CODE_EXTENSIONS)).alias("code_files"))
    return repositories(files).join(counted, "repo_id", "left").fillna(0, ["code_files"])


def _is_python() -> Column:
    return F.col("path").endswith(".py")


def project_structure(files: DataFrame) -> DataFrame:
    """One row per visible Python or configuration file with its roles.  Rows,
    not lists per repository: a repository may hold any number of files."""
    low = F.lower("path")
    python = _is_python()
    config = ~python & T.has_extension(F.col("path"), R.CONFIG_EXTENSIONS)
    test = python & low.contains("test")
    return visible(files).where(python | config).select(
        "repo_id", "path", python.alias("is_python"), test.alias("is_test"),
        (python & ~test & low.isin(*MAIN_MODULES)).alias("is_main"), config.alias("is_config"))


def structure_counts(files: DataFrame) -> DataFrame:
    """Files of each role per repository."""
    roles = project_structure(files).groupBy("repo_id").agg(
        *[F.count_if(f"is_{r}").alias(f"{r}_files") for r in ("python", "test", "main", "config")])
    total = visible(files).groupBy("repo_id").agg(F.count("*").alias("total_files"))
    return (repositories(files).join(total, "repo_id", "left").join(roles, "repo_id", "left")
            .fillna(0))


def structure_suggestions(files: DataFrame) -> DataFrame:
    """Rows (repo_id, kind, value): essential and removable files and advice."""
    low = F.lower("path")
    kind = (F.when(T.contains_any(low, ESSENTIAL), "minimal_file")
            .when(T.contains_any(low, REMOVABLE), "removable_file"))
    by_file = project_structure(files).select(
        "repo_id", kind.alias("kind"), F.col("path").alias("value")).where("kind IS NOT NULL")
    advice = F.array_compact(F.array(
        F.when(F.col("python_files") > MANY_PYTHON, MANY_PYTHON_ADVICE),
        F.when(F.col("config_files") > MANY_CONFIG, MANY_CONFIG_ADVICE),
        *[F.lit(a) for a in STANDING_ADVICE]))
    by_repo = structure_counts(files).select(
        "repo_id", F.lit("improvement").alias("kind"), F.explode(advice).alias("value"))
    return by_file.unionByName(by_repo)
