"""Registered queries: one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.functions.classify import prose_class, prose_is_finding
from siftlake.operators import chunks, findings as FD, history, metrics as M, prefix, structure
from siftlake.operators.lines import annotated_lines, explode_lines
from siftlake.operators.matching import (
    filename_findings, kept_by_quality, kept_by_security, kept_simple, line_hits, long_file_findings, prepared_lines,
    pruned)
from siftlake.operators.scan_table import ScanTable
from siftlake.plans import report, scan
from siftlake.session import cut, fresh_path
from siftlake.sources import corpus, rule_tables, test_reports, tool_reports
from siftlake.streaming import jobs
from siftlake.workload import tables

FINDING = ["repo_id", "path", "line", "severity", "issue", "type", "code_snippet"]
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


@query
def rules_security(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.SECURITY).select(FINDING)


@query
def rules_quality(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.QUALITY).select(FINDING)


@query
def rules_performance(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.PERFORMANCE).select(FINDING)


@query
def rules_maintainability(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.MAINTAINABILITY).select(FINDING)


@query
def rules_best_practice(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.BEST_PRACTICE).select(FINDING)


@query
def rules_advanced(spark, sf):
    return scan.rule_findings(tables.files(spark, sf), R.ADVANCED).select(FINDING)


@query
def rule_filename(spark, sf):
    return filename_findings(tables.files(spark, sf)).select(FINDING)


@query
def rule_long_file(spark, sf):
    return long_file_findings(tables.files(spark, sf)).select(FINDING)


@query
def doc_missing_function(spark, sf):
    return scan.documentation_findings(tables.files(spark, sf), ["function"]).select(FINDING)


@query
def doc_missing_class(spark, sf):
    return scan.documentation_findings(tables.files(spark, sf), ["class"]).select(FINDING)


def _small_chunks(spark, sf):
    """Every file in chunks of 1 KB, as a giant file has them of 1 MB."""
    return chunks.placed_chunks(chunks.split_chunks(tables.files(spark, sf), chunk_bytes=1024))


def _chunk_docs(spark, sf, kind):
    hits = line_hits(_small_chunks(spark, sf).where(F.col("path").endswith(".py")), documentation=[kind])
    return hits.select(FINDING)


@query
def doc_missing_function_chunked(spark, sf):
    return _chunk_docs(spark, sf, "function")


@query
def doc_missing_class_chunked(spark, sf):
    return _chunk_docs(spark, sf, "class")


@query
def doc_markers(spark, sf):
    return scan.documentation_findings(tables.files(spark, sf), ["marker"]).select(FINDING)


OWN = R.RuleGroup("own", "quality", R.RANKS["quality"], (".py", ".js"), "raw", R.ONCE_PER_LINE, False, (
    R.Rule(r"""(['"]).*\1""", "Quoted text", "LOW"), R.Rule(r"zq|pass.*word", "Secret word", "HIGH"),
    R.Rule(r"\x54ODO", "Open end", "LOW"), R.Rule(r"retu.*?n", "Way out", "MEDIUM"),
    R.Rule(r"\w+.*=", "Assignment", "LOW")), mask=True)


@query
def rules_own(spark, sf):
    """A rule group that a user brings, with patterns of every kind."""
    return scan.rule_findings(tables.files(spark, sf), OWN).select(FINDING)


@query
def rules_table(spark, sf):
    """All built-in groups and the own one, written as a table and read from it."""
    path = fresh_path(spark, "rules")
    rule_tables.rule_rows(spark, (*R.ALL_GROUPS, OWN)).write.parquet(path)
    groups = rule_tables.read_rules(spark.read.parquet(path))
    return scan.rule_findings(tables.files(spark, sf), *groups).select("rank", *FINDING)


@query
def rules_watch_words(spark, sf):
    """A rule for each longer word of the benchmark texts: far more rules than an expression can hold."""
    groups = rule_tables.read_rules(tables.watch_rules(spark, sf))
    return scan.rule_findings(tables.files(spark, sf), *groups).select(FINDING)


# --- corpus, lines and scalar functions -------------------------------------

def _lines(spark, sf, **options):
    return prepared_lines(annotated_lines(tables.files(spark, sf), **options))


@query
def scan_corpus(spark, sf):
    path = F.col("path")
    sets = {"security": R.SECURITY_EXTENSIONS, "quality": R.QUALITY_EXTENSIONS,
            "style": R.STYLE_EXTENSIONS, "documentation": R.DOCUMENTATION_EXTENSIONS,
            "code": R.CODE_EXTENSIONS, "other_language": R.OTHER_LANGUAGE_EXTENSIONS,
            "payload": R.PAYLOAD_EXTENSIONS, "config": R.CONFIG_EXTENSIONS}
    return tables.files(spark, sf).select(
        "repo_id", "path", F.length("content").alias("chars"),
        *[T.has_extension(path, e).alias(f"in_{n}") for n, e in sets.items()])


@query
def scan_tree(spark, sf):
    """The documents as single files, read as a tree of repositories."""
    files = corpus.read_tree(spark, tables.written_tree(spark, sf))
    return files.select("repo_id", F.substring_index("path", "/", 1).alias("folder"),
                        F.md5(F.col("content").cast("binary")).alias("md5"), "size_bytes")


@query
def prune_dirs(spark, sf):
    files = corpus.prune_dirs(tables.files(spark, sf))
    return files.select("repo_id", "path", pruned(F.col("path"), R.IGNORED_DIRS).alias("ignored"))


@query
def repository_files(spark, sf):
    return corpus.visible(tables.files(spark, sf)).select("repo_id", "path")


@query
def decode_text(spark, sf):
    noise = F.unhex(F.lit("ff41c328e28242"))  # 0xff, A, half of a letter, (, cut sequence, B
    files = tables.files(spark, sf)
    raw = F.concat(F.col("content").cast("binary"), noise)
    return files.select("repo_id", "path", T.decode_text(raw).alias("text"))


@query
def explode_lines_(spark, sf):
    return explode_lines(tables.files(spark, sf)).select("repo_id", "path", "line", "raw")


@query
def explode_lines_iterated(spark, sf):
    return explode_lines(tables.files(spark, sf), iterate=True).select("repo_id", "path", "line", "raw")


@query
def strip_line(spark, sf):
    return explode_lines(tables.files(spark, sf)).select(
        "repo_id", "path", "line", T.strip(F.col("raw")).alias("stripped"))


@query
def strip_comments(spark, sf):
    return explode_lines(tables.files(spark, sf)).select(
        "repo_id", "path", "line", T.strip_comments(T.strip(F.col("raw")), T.comment_mark(F.col("ext"))).alias("clean"))


@query
def file_ext(spark, sf):
    return tables.files(spark, sf).select("repo_id", "path", T.file_ext(F.col("path")).alias("ext"))


def _urls(spark, sf):
    return tables.test_reports(spark, sf).select("report_id", "repo_url")


@query
def repo_name(spark, sf):
    return _urls(spark, sf).withColumn("name", T.repo_name(F.col("repo_url")))


@query
def owner_repo(spark, sf):
    url = F.col("repo_url")
    return _urls(spark, sf).withColumns({"owner": T.owner_name(url), "repo": T.owned_repo_name(url)})


@query
def valid_repo_url(spark, sf):
    url = F.col("repo_url")
    return _urls(spark, sf).withColumns({"valid": T.valid_repo_url(url), "unusual": T.unusual_host(url)})


@query
def safe_filename(spark, sf):
    return tables.files(spark, sf).select("repo_id", "path", T.safe_filename(F.col("path")).alias("safe"))


@query
def snippet_clip(spark, sf):
    return explode_lines(tables.files(spark, sf)).select(
        "repo_id", "path", "line", T.snippet_clip(F.col("raw"), 80).alias("clip80"),
        T.snippet_clip(F.col("raw"), 100).alias("clip100"))


@query
def parse_coverage(spark, sf):
    return test_reports.ingest_test_report(tables.test_reports(spark, sf)).select(
        "repo_id", "report_id", "coverage_percent", "coverage")


@query
def clean_report_path(spark, sf):
    dotted = F.concat(F.lit(" ./"), F.col("path"), F.lit("\t"))
    up = F.concat(F.lit("../"), F.col("path"))
    return tables.files(spark, sf).select(
        "repo_id", "path", T.clean_report_path(dotted).alias("from_dot"),
        T.clean_report_path(up).alias("from_up"), T.clean_report_path(F.col("path")).alias("from_path"))


# --- line filters -----------------------------------------------------------

@query
def skip_lines_security(spark, sf):
    return _lines(spark, sf, docs=False).where(kept_by_security()).select("repo_id", "path", "line", "clean")


@query
def skip_lines_quality(spark, sf):
    return _lines(spark, sf, docs=False).where(kept_by_quality()).select(
        "repo_id", "path", "line", "stripped")


@query
def skip_lines_simple(spark, sf):
    return _lines(spark, sf, docs=False).where(kept_simple()).select(
        "repo_id", "path", "line", "stripped")


@query
def mask_block_comments(spark, sf):
    return annotated_lines(tables.files(spark, sf), docs=False).where("NOT masked").select(
        "repo_id", "path", "line", "raw")


@query
def mask_block_comments_chunked(spark, sf):
    return chunks.annotated_chunks(_small_chunks(spark, sf), docs=False).where("NOT masked").select(
        "repo_id", "path", "line", "raw")


@query
def tree_line_blocks(spark, sf):
    """The documents as single files, read as blocks of lines and numbered."""
    blocks = corpus.read_line_blocks(spark, tables.written_tree(spark, sf), chunk_lines=50)
    rows = chunks.placed_chunks(blocks).select("repo_id", "path", "first_line", "file_lines", F.posexplode("lines").alias("pos", "raw"))
    return rows.select("repo_id", F.substring_index("path", "/", 1).alias("folder"), (F.col("first_line") + F.col("pos")).alias("line"),
                       F.col("file_lines").alias("lines"), F.md5(F.col("raw").cast("binary")).alias("md5"))


@query
def drop_blank_files(spark, sf):
    # each line as a file of its own: many of them are blank
    small = explode_lines(tables.files(spark, sf)).select(
        "repo_id", F.concat_ws("#", "path", F.col("line").cast("string")).alias("path"),
        F.col("raw").alias("content"))
    return corpus.drop_blank_files(small).select("repo_id", "path")


@query
def max_file_size(spark, sf):
    files = tables.files(spark, sf)
    return files.select("repo_id", "path", corpus.size_ok(files).alias("standard"),
                        corpus.size_ok(files, deep=True).alias("deep"))


@query
def size_budget(spark, sf):
    sizes = corpus.payload_sizes(tables.files(spark, sf))
    return prefix.size_budget(sizes, corpus.PAYLOAD_CHARS[False]).select("repo_id", "path", "chars", "before")


@query
def prompt_text(spark, sf):
    files = tables.files(spark, sf)
    kept = prefix.size_budget(corpus.payload_sizes(files), corpus.PAYLOAD_CHARS[False])
    return corpus.prompt_text(files, kept)


# --- findings of other tools and test reports -------------------------------

TOOL = ["repo_id", "report_id", "rule", "path", "line", "severity", "issue", "type"]


def _bandit(spark, sf):
    return tool_reports.ingest_bandit(tables.bandit_reports(spark, sf), tables.ROOT)


def _pylint(spark, sf):
    return tool_reports.ingest_pylint(tables.pylint_reports(spark, sf), tables.ROOT)


@query
def ingest_bandit_json(spark, sf):
    return _bandit(spark, sf).select(TOOL)


@query
def ingest_pylint_json(spark, sf):
    return _pylint(spark, sf).select(TOOL)


@query
def ingest_semgrep_json(spark, sf):
    return tool_reports.ingest_semgrep(tables.semgrep_reports(spark, sf), tables.ROOT).select(
        TOOL + ["column", "code_snippet", "rule_id", "description", "tool"])


@query
def ingest_llm_json(spark, sf):
    return tool_reports.ingest_model(tables.model_responses(spark, sf)).select(TOOL)


@query
def classify_text_lines(spark, sf):
    lines = tables.model_responses(spark, sf).select(
        "repo_id", "report_id", F.posexplode(F.split("report", "\n", -1)).alias("rule", "text"))
    return lines.where(prose_is_finding(F.col("text"))).select(
        "repo_id", "report_id", "rule", prose_class(F.col("text"))["type"].alias("type"),
        prose_class(F.col("text"))["severity"].alias("severity"))


@query
def cap_llm_lines(spark, sf):
    return tables.model_responses(spark, sf).select(
        "repo_id", "report_id", F.posexplode(tool_reports.prose_findings(
            F.col("report"), tool_reports.PROSE_LIMIT)).alias("rule", "f"),
    ).select("repo_id", "report_id", "rule", "f.issue", "f.type", "f.severity")


@query
def cap_tool_findings(spark, sf):
    cap = tool_reports.cap_findings
    return cap(_bandit(spark, sf)).unionByName(cap(_pylint(spark, sf))).select("tool", *TOOL)


@query
def snippet_lookup(spark, sf):
    rows = _bandit(spark, sf).unionByName(_pylint(spark, sf)).unionByName(
        tool_reports.ingest_model(tables.model_responses(spark, sf)), allowMissingColumns=True)
    return tool_reports.snippet_lookup(cut(rows), tables.files(spark, sf)).select(
        "tool", *TOOL, "code_snippet")


@query
def tool_or_rules(spark, sf):
    tool = cut(tool_reports.snippet_lookup(cut(_pylint(spark, sf)), tables.files(spark, sf)))
    own = scan.rule_findings(tables.files(spark, sf), R.QUALITY)
    return FD.tool_or_rules(tool.select(FINDING), own.select(FINDING))


@query
def ingest_test_report(spark, sf):
    return test_reports.ingest_test_report(tables.test_reports(spark, sf)).select(
        "repo_id", "report_id", "repository", "language", "total_tests", "total", "passed", "failed",
        "coverage_percent", F.coalesce(F.size("test_details"), F.lit(0)).alias("tests"))


@query
def test_summary(spark, sf):
    return test_reports.test_summary(tables.test_reports(spark, sf))


@query
def failed_tests(spark, sf):
    return test_reports.failed_tests(tables.test_reports(spark, sf))


@query
def report_structure_ok(spark, sf):
    return tables.test_reports(spark, sf).select(
        "repo_id", "report_id", test_reports.report_structure_ok(F.col("report")).alias("ok"))


@query
def distinct_report_paths(spark, sf):
    return test_reports.report_paths(tables.test_reports(spark, sf))


@query
def report_paths_found(spark, sf):
    paths = test_reports.report_paths(tables.test_reports(spark, sf))
    return test_reports.paths_found(paths, tables.files(spark, sf))


@query
def report_matches_repo(spark, sf):
    rows = test_reports.report_match(tables.test_reports(spark, sf), tables.files(spark, sf))
    return rows.withColumn("missing", F.array_join("missing", "|"))


@query
def report_metadata_match(spark, sf):
    return test_reports.report_metadata_match(tables.test_reports(spark, sf))


# --- the combined findings --------------------------------------------------

@query
def union_findings(spark, sf):
    return tables.findings(spark, sf).select(
        "tool", F.col("rank").cast("int").alias("source_rank"), "report_id", *FINDING)


@query
def gate_by_language(spark, sf):
    files = tables.files(spark, sf)
    return FD.gate_by_language(scan.own_findings(files), FD.repo_gates(files)).select(FINDING)


@query
def minimal_fix(spark, sf):
    return tables.findings(spark, sf).where("minimal_fix IS NOT NULL").select(
        "repo_id", "path", "line", "issue", "minimal_fix.*")


@query
def dedup_exact(spark, sf):
    found = scan.rule_findings(tables.files(spark, sf), R.SECURITY)
    return FD.dedup_exact(found.unionByName(found)).select(FINDING)


@query
def first_per_message(spark, sf):
    hits = line_hits(tables.files(spark, sf), [R.SECURITY, R.QUALITY])
    return FD.first_per_message(hits).select(FINDING)


@query
def advanced_not_seen(spark, sf):
    files = tables.files(spark, sf)
    extra = scan.rule_findings(files, R.ADVANCED)
    seen = scan.rule_findings(files, R.SECURITY).unionByName(extra.where("severity = 'HIGH'"))
    return FD.not_seen(extra, seen).select(FINDING)


@query
def drop_empty_issues(spark, sf):
    return report.drop_empty_issues(tables.findings(spark, sf)).select("tool", *FINDING)


@query
def critical_list(spark, sf):
    return tables.findings(spark, sf).where("type = 'security' AND severity = 'CRITICAL'").select(FINDING)


@query
def by_type(spark, sf):
    return M.by_type(tables.findings(spark, sf))


@query
def by_severity(spark, sf):
    return M.by_severity(tables.findings(spark, sf))


@query
def by_file(spark, sf):
    return M.by_file(tables.findings(spark, sf))


@query
def breakdown(spark, sf):
    return M.breakdown(tables.findings(spark, sf))


@query
def top_files(spark, sf):
    return M.top_files(tables.findings(spark, sf))


def _counts(spark, sf):
    return M.raw_counts(tables.findings(spark, sf), tables.repos(spark, sf))


def _metrics(spark, sf):
    return M.metrics(_counts(spark, sf), tables.coverage(spark, sf))


@query
def raw_counts(spark, sf):
    return _counts(spark, sf).select(
        "repo_id", "total_issues", *[f"{t}_issues" for t in M.ISSUE_TYPES], "critical_issues", "high_issues")


@query
def scores(spark, sf):
    return M.scores(_counts(spark, sf)).select(
        "repo_id", "security_score", "quality_score", "performance_score", "overall_score")


@query
def file_scores(spark, sf):
    """The scores with a file in the place of a repository, so that all bands occur."""
    found = tables.findings(spark, sf).withColumn("repo_id", F.concat_ws("/", "repo_id", "path"))
    rows = M.metrics(M.raw_counts(found))
    return rows.select("repo_id", "security_score", "quality_score", "performance_score", "overall_score",
                       "risk_level", "remediation_effort", "compliance_status", "issue_density",
                       "maintainability_index")


@query
def risk_level(spark, sf):
    return _metrics(spark, sf).select("repo_id", "risk_level")


@query
def remediation_effort(spark, sf):
    return _metrics(spark, sf).select("repo_id", "effort_points", "remediation_effort")


@query
def compliance(spark, sf):
    return _metrics(spark, sf).select("repo_id", "compliance_status")


@query
def issue_density(spark, sf):
    return _metrics(spark, sf).select("repo_id", "test_coverage", "issue_density")


@query
def maintainability_index(spark, sf):
    return _metrics(spark, sf).select("repo_id", "maintainability_index")


@query
def executive_summary(spark, sf):
    return _metrics(spark, sf).select("repo_id", M.executive_summary().alias("summary"))


@query
def impact_assessment(spark, sf):
    found = tables.findings(spark, sf).withColumn("repo_id", F.concat_ws("/", "repo_id", "path"))
    return M.metrics(M.raw_counts(found)).withColumn("impact", M.impact()).select("repo_id", "impact.*")


@query
def repo_profile(spark, sf):
    return M.repo_profile(_counts(spark, sf)).select(
        "repo_id", "name", "owner", "language", "project_type", "complexity")


@query
def security_subcategory(spark, sf):
    return M.security_areas(tables.findings(spark, sf))


@query
def quality_subcategory(spark, sf):
    return M.quality_areas(tables.findings(spark, sf))


@query
def fix_count(spark, sf):
    return _counts(spark, sf).select("repo_id", "fixes")


@query
def trend(spark, sf):
    return M.trend(_counts(spark, sf))


@query
def recommendations(spark, sf):
    return M.recommendations(M.repo_profile(_counts(spark, sf)))


@query
def assessment_rollup(spark, sf):
    return M.assessment_rollup(tables.findings(spark, sf))


@query
def assessment_findings(spark, sf):
    return M.assessment_findings(tables.findings(spark, sf)).select("section", *FINDING)


@query
def scan_stats(spark, sf):
    return structure.scan_stats(tables.files(spark, sf))


@query
def count_code_files(spark, sf):
    return structure.count_code_files(tables.files(spark, sf))


@query
def project_structure(spark, sf):
    return structure.project_structure(tables.files(spark, sf))


@query
def structure_suggestions(spark, sf):
    return structure.structure_suggestions(tables.files(spark, sf))


@query
def accuracy_metrics(spark, sf):
    counts = structure.structure_counts(tables.files(spark, sf))
    rows = M.accuracy_metrics(counts, _counts(spark, sf))
    shown = ("detection_accuracy", "false_positive_rate", "scan_completeness")
    return rows.withColumns({c: F.round(c, 6) for c in shown})


@query
def report_json(spark, sf):
    return report.report_json(tables.findings(spark, sf), tables.repos(spark, sf).select("repo_id"))


@query
def report_documents(spark, sf):
    """The same as one document per repository, in lines."""
    rows = report.report_json(tables.findings(spark, sf), tables.repos(spark, sf).select("repo_id"))
    return report.json_documents(rows)


@query
def report_text(spark, sf):
    return report.report_text(tables.findings(spark, sf), tables.repos(spark, sf), "2024-02-01",
                              tables.coverage(spark, sf))


@query
def basic_report_text(spark, sf):
    return report.basic_report_text(tables.findings(spark, sf), tables.repos(spark, sf), "2024-02-01")


@query
def scan_rows(spark, sf):
    repos = tables.repos(spark, sf).withColumn("user_id", F.lit(1))
    return scan.scan_rows(tables.files(spark, sf), tables.findings(spark, sf), repos, "2024-02-01 00:00:00")


# --- scan history -----------------------------------------------------------

def _scans(spark, sf):
    return history.upsert_scans(tables.scan_base(spark, sf), tables.scan_updates(spark, sf), history.event_order())


def _flat(rows):
    return rows.withColumns({"issues": F.to_json("issues"), "unit_test_report": F.to_json("unit_test_report")})


@query
def upsert_scans(spark, sf):
    return _flat(_scans(spark, sf))


def _scan_table(spark, sf):
    """The base rows as a first version, then the updates in two writes."""
    base, updates = tables.scan_base(spark, sf), cut(tables.scan_updates(spark, sf), "updates")
    table = ScanTable(spark, fresh_path(spark, "scans"), base.schema, parts=8)
    table.upsert(base, order=("created_at",))
    early = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    for some in (updates.where(early), updates.where(~early)):
        table.upsert(some, history.event_order())
    return table


@query
def scan_table_upsert(spark, sf):
    return _flat(_scan_table(spark, sf).read())


@query
def scan_table_delete(spark, sf):
    table = _scan_table(spark, sf)
    table.delete(table.read().where("status = 'failed'").select("job_id", F.lit(3).alias("user_id")))
    return table.read().select("job_id", "user_id", "status")


@query
def scan_table_clear(spark, sf):
    table = _scan_table(spark, sf)
    table.clear(3)
    return table.read().select("job_id", "user_id", "status")


@query
def scan_store_rw(spark, sf):
    return _flat(history.scan_store_rw(_scans(spark, sf)))


@query
def get_scan(spark, sf):
    return _flat(history.get_scan(_scans(spark, sf), "job-8", 1))


@query
def recent_scans(spark, sf):
    return history.recent_scans_by_owner(_scans(spark, sf))


@query
def scan_history(spark, sf):
    return history.scan_history(_scans(spark, sf), "https://github.com/team/repo8", 1)


@query
def delete_scan(spark, sf):
    scans = _scans(spark, sf)
    doomed = scans.where("status = 'failed'").select("job_id", F.lit(3).alias("user_id"))
    return history.delete_scan(scans, doomed).select("job_id", "user_id", "status")


@query
def clear_scans(spark, sf):
    return history.clear_scans(_scans(spark, sf), 3).select("job_id", "user_id", "status")


@query
def visible_scans(spark, sf):
    return history.visible_scans(_scans(spark, sf), 2).select("job_id", "user_id", "status")


@query
def active_scans(spark, sf):
    return history.active_scans(_scans(spark, sf))


@query
def scan_duration(spark, sf):
    seconds, text = history.scan_duration(F.col("created_at"), F.col("updated_at"))
    return _scans(spark, sf).select("job_id", seconds.alias("seconds"), text.alias("scan_duration"))


# --- streams ----------------------------------------------------------------

@query
def stream_findings(spark, sf):
    schema = tables.table(spark, sf, "documents").schema
    stream = tables.as_files(jobs.read_stream(spark, sf, "documents.parquet", schema))
    return jobs.stream_findings(stream, *jobs.stream_paths(spark, "findings")).select(
        *FINDING, "minimal_fix.suggestion")


@query
def stream_scan_status(spark, sf):
    schema = tables.table(spark, sf, "events").schema
    stream = tables.scan_events(spark, sf, jobs.read_stream(spark, sf, "events.parquet", schema))
    return _flat(jobs.stream_scan_status(stream, *jobs.stream_paths(spark, "status")))


@query
def stream_scan_table(spark, sf):
    """The same with state, into the versioned table."""
    schema = tables.table(spark, sf, "events").schema
    stream = tables.scan_events(spark, sf, jobs.read_stream(spark, sf, "events.parquet", schema))
    out, state = jobs.stream_paths(spark, "status")
    table = ScanTable(spark, out, tables.scan_base(spark, sf).schema, parts=8)
    return _flat(jobs.stream_scan_table(stream, table, state))
