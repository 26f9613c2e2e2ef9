"""Test reports: known fields, paths anywhere in them, and how they fit a repository.

A report table has (repo_id, report_id, repo_url, report), report being JSON text."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.functions import text as T
from siftlake.operators.findings import top_per_group
from siftlake.session import cut

SCHEMA = ("repository string, language string, framework string, total_tests string, total string, "
          "passed string, failed string, coverage_percent string, "
          "test_details array<struct<name:string,file:string,status:string,duration:string,error:string>>")

# Fixed values.
REPORT_WORDS = ("tests", "test", "results", "result", "testsuites", "testsuite", "summary", "stats",
                "statistics", "coverage", "failures", "passed")
PATH_KEYS = ("file", "filename", "filepath", "path", "source_file", "test_file")
REPOSITORY_KEYS = ("repository", "repo", "project", "project_name", "repo_name", "repository_name",
                   "repository_url", "repo_url", "project_url")
METADATA_DEPTH = 3
MIN_MATCH_PERCENT, MIN_FILES = 30, 3
MISSING_KEPT, MISSING_SHOWN = 5, 3


def ingest_test_report(reports: DataFrame) -> DataFrame:
    """Known fields; each is optional."""
    return reports.withColumn("r", F.from_json("report", SCHEMA)).select(
        "repo_id", "report_id", "r.*", T.parse_coverage(F.col("r.coverage_percent")).alias("coverage"))


def test_summary(reports: DataFrame) -> DataFrame:
    """Fields that are missing read N/A."""
    missing = F.lit("N/A")
    return ingest_test_report(reports).select(
        "repo_id", "report_id",
        F.coalesce("total_tests", "total", missing).alias("total_tests"),
        F.coalesce("passed", missing).alias("passed"), F.coalesce("failed", missing).alias("failed"),
        F.coalesce("coverage_percent", missing).alias("coverage"))


def failed_tests(reports: DataFrame) -> DataFrame:
    """C8."""
    return ingest_test_report(reports).select(
        "repo_id", "report_id", F.explode("test_details").alias("t")).where("t.status = 'FAILED'").select(
        "repo_id", "report_id", "t.name", F.coalesce("t.error", F.lit("Test failed")).alias("error"),
        F.coalesce("t.duration", F.lit("N/A")).alias("duration"))


def is_object(report: Column) -> Column:
    return F.coalesce(F.from_json(report, "map<string,string>").isNotNull(), F.lit(False))


def report_structure_ok(report: Column) -> Column:
    """A JSON object that mentions tests."""
    return is_object(report) & T.contains_any(F.lower(report), REPORT_WORDS)


@contextlib.contextmanager
def _last_of_equal_keys(spark: SparkSession):
    """As most JSON readers have it; Spark otherwise refuses objects with equal keys."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def walk(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(all other columns, key, value) for each member of an object, at any depth below column ``v`` (a
    VARIANT), whose key is one of ``keys`` in whatever case.  Each round opens one level of all values
    at once; the rounds end with the deepest value."""
    spark, rest = values.sparkSession, [c for c in values.columns if c != "v"]
    names, found, level = ", ".join(f"`{c}`" for c in rest), None, values
    while True:
        rows = cut(spark.sql(
            f"SELECT {names}, key, value, schema_of_variant(value) AS kind FROM {{level}}, LATERAL variant_explode(v) AS t(pos, key, value)",
            level=level), "level")
        some = rows.where(F.lower("key").isin(*keys))
        found = some if found is None else found.unionByName(some)
        level = rows.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select(*rest, F.col("value").alias("v"))
        if level.isEmpty():
            return found


def report_paths(reports: DataFrame) -> DataFrame:
    """distinct path texts anywhere in a report.  The report is walked as a VARIANT, so keys and
    values count as they are meant, however they are written.  Text that is no JSON names no path; of
    equal keys in an object the last one counts."""
    with _last_of_equal_keys(reports.sparkSession):
        parsed = cut(reports.select("repo_id", "report_id", F.try_parse_json("report").alias("v")).where("v IS NOT NULL"), "reports")
        found = walk(parsed, PATH_KEYS)
    return found.where("kind = 'STRING'").select(
        "repo_id", "report_id", F.variant_get("value", "$", "string").alias("path")).distinct()


def existing_paths(files: DataFrame) -> DataFrame:
    """Files, all their directories and the root ('')."""
    every_dir = files.select("repo_id", F.split("path", "/").alias("parts")).select(
        "repo_id", F.slice("parts", 1, F.size("parts") - 1).alias("parts")).distinct()
    ancestors = every_dir.select("repo_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("parts")),
        lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("path"))
    return files.select("repo_id", "path").union(ancestors).distinct()


def _bare(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def paths_found(paths: DataFrame, files: DataFrame) -> DataFrame:
    """I2, per path: does the cleaned path, the path as given, or its base name at the
    root exist?  Candidates are made distinct before the join, so a path that a third
    of all reports name is looked up once."""
    clean = T.clean_report_path(F.col("path"))
    rows = paths.withColumn("clean", clean).withColumn("candidates", F.array_distinct(F.array(
        _bare(F.col("clean")),
        # as given: a leading slash leads out of the repository
        F.when(~F.col("path").startswith("/"), _bare(F.col("path"))).otherwise(_bare(F.col("clean"))),
        T.file_name(F.col("clean")))))
    wanted = rows.select("repo_id", "path", "clean", "candidates").distinct()
    known = existing_paths(files).select("repo_id", F.col("path").alias("candidate"),
                                         F.lit(True).alias("known"))
    flags = (
        wanted.select("repo_id", "path", F.explode("candidates").alias("candidate"))
        .join(known, ["repo_id", "candidate"], "left")
        .groupBy("repo_id", "path").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("found"))
    )
    return rows.select("repo_id", "report_id", "path", "clean").join(flags, ["repo_id", "path"])


def report_match(reports: DataFrame, files: DataFrame) -> DataFrame:
    """I2 and I3 per report: files found, total, the first missing ones, the verdict
    and the message of a failed one.  A report that names no path passes."""
    checked = paths_found(report_paths(reports), files)
    counts = checked.groupBy("repo_id", "report_id").agg(
        F.count_if("found").alias("files_found"), F.count("*").alias("total_files"))
    lacking = top_per_group(checked.where("NOT found"), ["repo_id", "report_id"], ["clean", "path"],
                            MISSING_KEPT).groupBy("repo_id", "report_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "clean")))["clean"].alias("missing"))
    rows = (
        reports.select("repo_id", "report_id")
        .join(counts, ["repo_id", "report_id"], "left").join(lacking, ["repo_id", "report_id"], "left")
        .fillna(0, ["files_found", "total_files"])
        .withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    )
    percent = F.when(F.col("total_files") > 0,
                     F.col("files_found") / F.col("total_files") * 100).otherwise(0.0)
    fails = (percent < MIN_MATCH_PERCENT) & (F.col("total_files") >= MIN_FILES)
    message = F.concat(
        F.lit("Unit test report does not match repository. Only "),
        F.col("files_found").cast("string"), F.lit("/"), F.col("total_files").cast("string"),
        F.lit(" test files found in repository. Missing files: "),
        F.array_join(F.slice("missing", 1, MISSING_SHOWN), ", "), F.lit("..."))
    return rows.withColumns({"matches": ~fails, "message": F.when(fails, message).otherwise("")})


_PAIRS = "array<struct<key:string,value:string>>"


def _candidates(json_text: Column, depth: int = 0) -> Column:
    """Key and text of what may name the repository in an object, in document order, with
    the same of its ``metadata`` in the place of that."""
    none = F.array().cast(_PAIRS)

    def of(e):
        low = F.lower(e["key"])
        wanted = low.isin(*REPOSITORY_KEYS)
        if depth <= 1:
            wanted = wanted | ((low == "name") & ~e["value"].startswith("test_"))
        files = F.from_json(e["value"], "files array<struct<path:string>>")["files"]
        path = F.element_at(F.filter(files, lambda f: f["path"].isNotNull()), -1)["path"]
        covered = F.when((low == "coverage") & path.isNotNull(), F.array(
            F.struct(F.lit("coverage_file").alias("key"), path.alias("value"))))
        parts = [F.when(wanted, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))), covered]
        if depth < METADATA_DEPTH:
            parts.append(F.when(low == "metadata", _candidates(e["value"], depth + 1)))
        return F.concat(*[F.coalesce(p, none) for p in parts])

    entries = F.map_entries(F.from_json(json_text, "map<string,string>"))
    return F.coalesce(F.flatten(F.transform(entries, of)), none)


def report_metadata_match(reports: DataFrame) -> DataFrame:
    """I4: does any repository field of the report contain the repository's name?
    The answer is a column and never a gate.  Of equal keys the later one counts."""
    rows = reports.withColumn("pairs", _candidates(F.col("report")))
    last = F.filter("pairs", lambda p, i: ~F.exists(
        F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["key"] == p["key"]))
    name = T.owned_repo_name(F.col("repo_url"))
    rows = rows.select("repo_id", "report_id", name.alias("repo_name"), last.alias("pairs"))
    hit = F.exists("pairs", lambda p: F.lower(p["value"]).contains(F.col("repo_name")))
    return rows.select(
        "repo_id", "report_id", "repo_name", F.size("pairs").cast("long").alias("metadata_fields"),
        F.coalesce(hit, F.lit(False)).alias("metadata_matches"))
