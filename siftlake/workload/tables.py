"""Inputs of the registered queries, derived from the given tables.

A document becomes a source file: a path worked out from its id, and a content of
code lines picked from a bank by its id, followed by the document's whole text."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siftlake.functions.text import sql_text
from siftlake.plans import scan
from siftlake.sources import test_reports as test_report_fields, tool_reports
from siftlake.session import fresh_path
from siftlake.workload.bank import BANK, DIRS, EXTENSIONS, STEMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(values) -> Column:
    """An array of texts as one literal."""
    cells = ", ".join("CAST(NULL AS STRING)" if v is None else sql_text(v) for v in values)
    return F.expr(f"array({cells})")


def pick(values, index: Column) -> Column:
    return F.get(texts(values), (index % len(values)).cast("int"))


def file_path(doc_id: Column) -> Column:
    no_python = (doc_id % 20).isin(3, 7)
    ext = pick(EXTENSIONS, doc_id)
    ext = F.when((ext == ".py") & no_python, ".js").otherwise(ext)
    root = F.when(no_python, ".js").otherwise(".py")
    usual = F.concat(pick(DIRS, doc_id), pick(STEMS, doc_id), doc_id.cast("string"), ext)
    return (F.when(doc_id < 20, F.concat(F.lit("main"), root))
            .when(doc_id < 40, F.concat(F.lit("app"), root)).otherwise(usual))


def file_content(doc_id: Column, text: Column) -> Column:
    count = F.when(doc_id % 97 == 5, 520).otherwise((16 + doc_id % 25).cast("int"))
    code = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get(
        texts(BANK), ((doc_id * 31 + k * 17) % len(BANK)).cast("int")))
    head = F.when(doc_id % 5 == 0, F.array_join(code, "\r\n")).otherwise(F.array_join(code, "\n"))
    tail = F.when(doc_id % 3 == 0, "\n").otherwise("")
    return F.concat(head, F.lit("\n"), text, tail)


def as_files(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id")
    return docs.select(F.col("source").alias("repo_id"), file_path(doc_id).alias("path"),
                       file_content(doc_id, F.col("text")).alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def watch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows: the words of six letters and more in the benchmark texts, in alphabetical order."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    words = words.where(F.length("word") >= 6).distinct()
    n = (F.row_number().over(Window.orderBy("word")) - 1).cast("int")  # a list of words is small
    return words.withColumn("ordinal", n).select(
        F.lit("watch").alias("group_name"), F.lit(90).alias("rank"), F.lit("quality").alias("issue_type"),
        F.array(F.lit(".py"), F.lit(".js"), F.lit(".rb")).alias("extensions"), F.lit("stripped").alias("text"),
        F.lit("first_per_message").alias("dedup"), F.lit(False).alias("prune"), F.lit("simple").alias("skip"), F.lit(False).alias("mask"),
        "ordinal", F.col("word").alias("pattern"), F.concat(F.lit("Watched word "), "word").alias("message"),
        pick(["LOW", "MEDIUM", "HIGH"], F.col("ordinal")).alias("severity"))


def _named(column: str, value: Column) -> Column:
    """A part of a path as Spark names folders of partitions."""
    marks = r"([\x01-\x1f\x7f\"#%'*/:=?\\\\{\[\]^])"
    escaped = F.array_join(F.transform(F.split(value.cast("string"), ""), lambda c: F.when(
        c.rlike(marks), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.concat(F.lit(f"{column}="), F.coalesce(F.nullif(escaped, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))


def _write_files(root: str):
    """Function for ``mapInArrow`` that writes rows (repo, name, value), equal names behind each other, as files."""
    def write(batches):
        if root.startswith("file:"):
            system, top = pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", root)
        else:
            system, top = pa.fs.FileSystem.from_uri(root)
        made, at, out, count = set(), None, None, 0
        for batch in batches:
            for repo, name, value in zip(*(batch.column(c).to_pylist() for c in ("repo", "name", "value"))):
                if (repo, name) != at:
                    if out:
                        out.close()
                    if repo not in made:
                        system.create_dir(f"{top}/{repo}", recursive=True)
                        made.add(repo)
                    at, out, count = (repo, name), system.open_output_stream(f"{top}/{repo}/{name}"), count + 1
                out.write(value)
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    return write


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files below a new folder of the shared folder; its path repeats a
    name and has letters that mean something in a pattern.  Spark's writer makes a folder for every
    file, and listing them costs a task each; here a file lies in the folder of its repository.
    Documents of one id stand in one file."""
    base = fresh_path(spark, "tree")
    spark.range(1).select(F.lit("").alias("value")).write.text(f"{base}/mark")  # tells the address with its scheme
    base = spark.read.text(f"{base}/mark").select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).first()[0]
    root = f"{base.rsplit('/', 2)[0]}/c++/data/data"
    rows = table(spark, sf_dir, "documents").select(
        _named("repo", F.col("source")).alias("repo"), _named("name", F.col("doc_id")).alias("name"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("value"))
    rows.repartition("repo", "name").sortWithinPartitions("repo", "name").mapInArrow(
        _write_files(root), "files long").agg(F.sum("files")).collect()
    return root


def repo_url(repo_id: Column, doc_id: Column, lang: Column) -> Column:
    """Addresses in the forms that a user types."""
    web = F.concat(F.lit("https://github.com/"), lang, F.lit("/"), repo_id)
    forms = [F.concat(web, F.lit(".git")), F.concat(web, F.lit("/")),
             F.concat(F.lit("  git@gitlab.com:"), F.initcap(lang), F.lit("/"), F.upper(repo_id), F.lit(".git ")),
             repo_id, F.concat(F.lit("git@host:"), repo_id), web, F.lit("https://x.y/"),
             F.concat(F.lit("https://host.example/group/sub/"), repo_id, F.lit("-api.git/"))]
    return F.get(F.array(*forms), (doc_id % len(forms)).cast("int"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, repo_url)"""
    suffix = ["-api", "-web.git", "-lib", ""]
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("repo_id")).agg(F.min("doc_id").alias("d")).select(
        "repo_id", F.concat(F.lit("https://github.com/team/"), F.col("repo_id"),
                            pick(suffix, F.col("d"))).alias("repo_url"))


ROOT = "/scan"
BANDIT_TEXTS = ["Use of assert detected.", "Consider possible security implications with subprocess module.",
                "Possible hardcoded password: 'x'", "Using IMPORT hooks", "Use of insecure MD5 hash function."]
PYLINT_TEXTS = ["Unused variable 'a'", "Undefined variable 'b'", "Unable to import 'c'",
                "Dangerous default value [] as argument", "Missing module docstring"]
PYLINT_TYPES = ["error", "warning", "convention", "warning"]
SEMGREP_LEVELS = ["ERROR", "warning", "INFO", "EXPERIMENT", None]
SEMGREP_AREAS = ["security", "best-practice", "correctness", "performance", "maintainability",
                 "style", None]


def _source_no(doc_id: Column) -> Column:
    return doc_id % 20


def _tool_base(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("repo_id"), file_path(F.col("doc_id")).alias("path"))


def bandit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per file with doc_id % 4 results.  The text follows the repository,
    so some repositories keep no result at all."""
    d = F.col("doc_id")
    results = F.transform(F.sequence(F.lit(1), d % 4), lambda k: F.struct(
        F.concat(F.lit(ROOT + "/"), F.col("path")).alias("filename"),
        (k * 3 + d % 5).cast("int").alias("line_number"),
        pick(["LOW", "MEDIUM", "HIGH"], d + k).alias("issue_severity"),
        pick(BANDIT_TEXTS, _source_no(d)).alias("issue_text")))
    none = F.array().cast("array<struct<filename:string,line_number:int,issue_severity:string,issue_text:string>>")
    return _tool_base(spark, sf_dir).select("repo_id", d.alias("report_id"), F.to_json(F.struct(
        F.when(d % 4 == 0, none).otherwise(results).alias("results"))).alias("report"))


def pylint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = F.transform(F.sequence(F.lit(1), d % 3 + 1), lambda k: F.struct(
        pick(PYLINT_TYPES, d + k).alias("type"), pick(PYLINT_TEXTS, _source_no(d)).alias("message"),
        F.concat(F.lit(ROOT + "/"), F.col("path")).alias("path"), (k + d % 7).cast("int").alias("line")))
    return _tool_base(spark, sf_dir).select("repo_id", d.alias("report_id"), F.to_json(rows).alias("report"))


def semgrep_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are null are left out of the JSON."""
    d = F.col("doc_id")
    rows = F.transform(F.sequence(F.lit(1), d % 3 + 1), lambda k: F.struct(
        F.concat(F.when(d % 2 == 0, ROOT + "/").otherwise(""), F.col("path")).alias("path"),
        F.when(d % 6 != 1, F.concat(F.lit("rule."), (d % 9).cast("string"))).alias("check_id"),
        F.struct(F.when(d % 5 != 2, (k + d % 7).cast("int")).alias("line"),
                 F.when(d % 5 != 3, k.cast("int")).alias("col")).alias("start"),
        F.struct(pick(SEMGREP_LEVELS, d + k).alias("severity"),
                 F.when(d % 7 != 4, F.concat(F.lit("finding "), k.cast("string"))).alias("message"),
                 F.when(d % 11 != 4, F.concat(F.lit("line \""), F.col("path"), F.lit("\""))).alias("lines"),
                 F.struct(pick(SEMGREP_AREAS, d + k * 2).alias("category")).alias("metadata"),
                 ).alias("extra")))
    return _tool_base(spark, sf_dir).select("repo_id", d.alias("report_id"), F.to_json(
        F.struct(rows.alias("results"))).alias("report"))


PROSE = [
    "A security hole in login", "Outdated package found", "The loop is slow", "null pointer here",
    "A race between threads", "Not a good practice", "Too nested for readers", "The docstring lies",
    "Missing ARIA label", "Tight coupling of parts", "A dead branch", "This is fine", "",
    "  A duplicate method, which has a text that goes on for so many words that it must be cut to be shown  ",
    "An issue somewhere", "See the API", "Nothing to report",
]


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per turn: JSON inside prose, prose, or broken JSON in prose."""
    c, t = F.col("conv_id"), F.col("turn")
    prose = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), (c + t) % 30 + 1), lambda k: pick(
        PROSE, c * 7 + t * 5 + k * 3)), "\n"), F.lit("\n"), F.col("text"))
    issues = F.transform(F.sequence(F.lit(1), c % 3 + 1), lambda k: F.struct(
        F.when(c % 2 == 0, "main.py").otherwise(F.concat(F.lit("f"), c.cast("string"), F.lit(".py"))).alias("file"),
        (t + k).cast("int").alias("line"),
        pick(["security", "quality", "accessibility", "testability"], c + k).alias("type"),
        pick(["HIGH", "MEDIUM", "LOW"], t + k).alias("severity"),
        F.col("text").alias("issue")))
    whole = F.concat(F.lit("Found these:\n"), F.to_json(F.struct(issues.alias("issues"))), F.lit("\nDone."))
    broken = F.concat(F.lit('{"issues": [ '), prose, F.lit(" }"))
    text = F.when(t % 3 == 0, whole).when(t % 3 == 1, prose).otherwise(broken)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("src"), (c % 20).cast("string")).alias("repo_id"),
        (c * 100 + t).alias("report_id"),
        text.alias("report"))


COVERAGES = ["85.5%", " 40 ", "n/a", "12.25", None]


def test_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test report per document, with fields that come and go."""
    d = F.col("doc_id")
    path = F.col("path")
    name = F.concat(F.lit("test_"), d.cast("string"))
    details = F.transform(F.sequence(F.lit(0), d % 4), lambda k: F.struct(
        F.concat(name, F.lit("_"), k.cast("string")).alias("name"),
        F.get(F.array(path, F.concat(F.lit("./"), path), F.concat(F.lit("gone/x"), d.cast("string"), F.lit(".py")),
                      F.lit("old/main.py")), (d + k).cast("int") % 4).alias("file"),
        pick(["PASSED", "FAILED", "SKIPPED"], d + k).alias("status"),
        F.when(d % 3 != 0, F.concat((k + 1).cast("string"), F.lit("s"))).alias("duration"),
        F.when(d % 2 == 0, F.concat(F.lit('say "no" at '), path)).alias("error")))
    extra = F.struct(
        F.when(d % 3 == 1, F.concat(F.lit("team/"), F.col("repo_id"))).alias("project"),
        F.struct(F.when(d % 5 == 1, F.concat(F.lit("x/"), F.col("repo_id"))).alias("repo_url"),
                 F.when(d % 7 == 1, F.col("repo_id")).alias("name")).alias("metadata"))
    files = F.array(F.struct(path.alias("path")), F.struct(F.concat(F.lit("lost/"), path).alias("path")))
    body = F.struct(
        F.when(d % 4 == 0, F.concat(F.lit("en/"), F.col("repo_id"))).alias("repository"),
        F.lit("Python").alias("language"), extra["project"].alias("project"),
        extra["metadata"].alias("metadata"),
        F.when(d % 3 != 2, (d % 4 + 1).cast("int")).alias("total_tests"),
        F.when(d % 3 == 2, (d % 4 + 1).cast("int")).alias("total"),
        F.when(d % 6 != 5, (d % 4).cast("int")).alias("passed"),
        F.when(d % 5 != 4, F.lit(1)).alias("failed"),
        pick(COVERAGES, d).alias("coverage_percent"),
        F.when(d % 6 == 0, F.struct(files.alias("files"))).alias("coverage"),
        F.when(d % 9 != 8, details).alias("test_details"))
    empty = F.struct(F.lit("none").alias("kind"), F.lit(1).alias("n"))
    report = (F.when(d % 50 == 7, F.to_json(F.array(F.struct(name.alias("test")))))
              .when(d % 50 == 8, F.to_json(empty)).otherwise(F.to_json(body)))
    docs = table(spark, sf_dir, "documents")
    return docs.select(d, F.col("source").alias("repo_id"), "lang", file_path(d).alias("path")).select(
        "repo_id", d.alias("report_id"), repo_url(F.col("repo_id"), d, F.col("lang")).alias("repo_url"),
        report.alias("report"))


STATUS = {"signup": "queued", "click": "running", "view": "running", "purchase": "completed",
          "error": "failed"}


def scan_events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Writes of scan rows: an event is one write of the job of its user."""
    rows = table(spark, sf_dir, "events") if rows is None else rows
    u, e = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.map_from_arrays(F.lit(list(STATUS)), F.lit(list(STATUS.values()))), F.col("event_type"))
    return rows.select(
        F.concat(F.lit("job-"), u.cast("string")).alias("job_id"),
        F.nullif((u % 7).cast("int"), F.lit(0)).alias("user_id"),
        F.concat(F.lit("https://github.com/team/repo"), (u % 11).cast("string")).alias("repo_url"),
        status.alias("status"), k.alias("total_issues"), (e % 13).cast("int").alias("security_issues"),
        (e % 17).cast("int").alias("quality_issues"), (e % 19).cast("int").alias("files_scanned"),
        (e % 5).cast("int").alias("directories_scanned"),
        F.when(e % 3 != 0, F.array(F.struct(F.col("event_type").alias("issue"), k.alias("line")))).alias("issues"),
        F.when(e % 4 != 0, F.struct(k.alias("total_tests"))).alias("unit_test_report"),
        e.alias("event_id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.when(status == "completed", F.col("ts")).alias("completed_at"))


CUTOVER = "2024-01-20"


def scan_base(spark, sf_dir) -> DataFrame:
    """The scan table as it stood at the cutover."""
    from siftlake.operators.history import event_order, last_per_job

    return last_per_job(scan_events(spark, sf_dir).where(F.col("updated_at") < F.lit(CUTOVER).cast("timestamp")),
                        event_order())


def scan_updates(spark, sf_dir) -> DataFrame:
    return scan_events(spark, sf_dir).where(F.col("updated_at") >= F.lit(CUTOVER).cast("timestamp"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined findings of all sources (F1)."""
    corpus = files(spark, sf_dir)
    bandit = tool_reports.ingest_bandit(bandit_reports(spark, sf_dir), ROOT)
    pylint = tool_reports.ingest_pylint(pylint_reports(spark, sf_dir), ROOT)
    return scan.scan(
        corpus, bandit.unionByName(pylint),
        tool_reports.ingest_semgrep(semgrep_reports(spark, sf_dir), ROOT),
        tool_reports.ingest_model(model_responses(spark, sf_dir)))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, test_coverage) from the latest report of each repository."""
    known = test_report_fields.ingest_test_report(test_reports(spark, sf_dir))
    return known.groupBy("repo_id").agg(F.max_by("coverage", "report_id").alias("test_coverage"))
