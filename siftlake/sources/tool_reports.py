"""Findings that other tools wrote as JSON.

A report table has (repo_id, report_id, report); the order of a repository's rows
is (report_id, position in the report)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.functions.classify import prose_class, prose_is_finding
from siftlake.operators.findings import top_per_group
from siftlake.session import cut

BANDIT = "results array<struct<filename:string,line_number:int,issue_severity:string,issue_text:string>>"
PYLINT = "array<struct<type:string,message:string,path:string,line:int>>"
SEMGREP = ("results array<struct<path:string,check_id:string,start:struct<line:int,col:int>,"
           "extra:struct<severity:string,message:string,lines:string,"
           "metadata:struct<category:string>>>>")
MODEL_ISSUE = "struct<file:string,line:string,type:string,severity:string,issue:string,code_snippet:string>"
MODEL = f"array<struct<issues:array<{MODEL_ISSUE}>>>"

# Fixed values.
BANDIT_SKIP = ("import", "module")
PYLINT_SKIP = ("import", "unused", "module")
PYLINT_KEEP = ("error", "warning")
SEMGREP_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
SEMGREP_TYPE = {"security": "security", "best-practice": "best_practice", "correctness": "quality",
                "performance": "performance", "maintainability": "maintainability"}
SEMGREP_MESSAGE = "Security issue detected"
TOOL_LIMIT = 10
PROSE_LIMIT = 20
PROSE_FILE = "detected_file"
PROSE_CLIP = 100


def _mapped(key: Column, table: dict, default: str) -> Column:
    return F.coalesce(F.element_at(F.map_from_arrays(
        F.lit(list(table)), F.lit(list(table.values()))), key), F.lit(default))


def _without_root(path: Column, root: str) -> Column:
    return F.replace(path, F.lit(root), F.lit(""))


def _rows(reports: DataFrame, array: Column) -> DataFrame:
    return reports.select("repo_id", "report_id", F.posexplode(array).alias("rule", "r"))


def ingest_bandit(reports: DataFrame, root: str) -> DataFrame:
    """A4: security findings; those about imports are dropped."""
    low = F.lower("r.issue_text")
    return _rows(reports, F.from_json("report", BANDIT)["results"]).where(
        ~T.contains_any(low, BANDIT_SKIP)
    ).select(
        "repo_id", "report_id", "rule", _without_root(F.col("r.filename"), root).alias("path"),
        F.col("r.line_number").alias("line"), F.col("r.issue_severity").alias("severity"),
        F.col("r.issue_text").alias("issue"), F.lit("security").alias("type"),
        F.lit(R.RANKS["security"]).alias("rank"), F.lit("bandit").alias("tool"))


def ingest_pylint(reports: DataFrame, root: str) -> DataFrame:
    """A5: errors and warnings that are not about imports."""
    low = F.lower("r.message")
    return _rows(reports, F.from_json("report", PYLINT)).where(
        F.col("r.type").isin(*PYLINT_KEEP) & ~T.contains_any(low, PYLINT_SKIP)
    ).select(
        "repo_id", "report_id", "rule", _without_root(F.col("r.path"), root).alias("path"),
        F.col("r.line").alias("line"), F.col("r.type").alias("severity"),
        F.col("r.message").alias("issue"), F.lit("quality").alias("type"),
        F.lit(R.RANKS["quality"]).alias("rank"), F.lit("pylint").alias("tool"))


def ingest_semgrep(reports: DataFrame, root: str) -> DataFrame:
    """The text goes to ``description``; ``issue`` stays empty."""
    path = F.coalesce("r.path", F.lit(""))
    inside = path.startswith(root)
    relative = F.ltrim(F.substring(path, F.lit(len(root) + 1), F.length(path)), F.lit("/"))
    severity = F.upper(F.coalesce("r.extra.severity", F.lit("WARNING")))
    category = F.coalesce("r.extra.metadata.category", F.lit("security"))
    return _rows(reports, F.from_json("report", SEMGREP)["results"]).select(
        "repo_id", "report_id", "rule", F.when(inside, relative).otherwise(path).alias("path"),
        F.coalesce("r.start.line", F.lit(1)).alias("line"),
        F.coalesce("r.start.col", F.lit(1)).alias("column"),
        _mapped(severity, SEMGREP_SEVERITY, "MEDIUM").alias("severity"),
        F.lit(None).cast("string").alias("issue"),
        _mapped(category, SEMGREP_TYPE, "security").alias("type"),
        F.coalesce("r.extra.lines", F.lit("")).alias("code_snippet"),
        F.coalesce("r.check_id", F.lit("semgrep")).alias("rule_id"),
        F.coalesce("r.extra.message", F.lit(SEMGREP_MESSAGE)).alias("description"),
        F.lit(R.RANKS["semgrep"]).alias("rank"), F.lit("semgrep").alias("tool"))


def prose_findings(text: Column, limit: int | None = None) -> Column:
    """An array of findings from the lines of a model's prose, all of them or, with
    ``limit`` (E5), the first ones.  It stays within the row: there is nothing to shuffle."""
    kept = F.filter(F.split(text, "\n", -1), prose_is_finding)
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    classed = F.transform(kept, lambda line: F.struct(
        prose_class(line).alias("c"), T.snippet_clip(line, PROSE_CLIP).alias("issue")))
    return F.transform(classed, lambda x: F.struct(
        F.lit(PROSE_FILE).alias("path"), F.lit(1).alias("line"), x["c"]["type"].alias("type"),
        x["c"]["severity"].alias("severity"), x["issue"].alias("issue"),
        F.lit(None).cast("string").alias("code_snippet")))


def ingest_model(responses: DataFrame) -> DataFrame:
    """Issues of the JSON object between the first and the last brace; a text
    without one is read as prose.  (repo_id, report_id, report)"""
    # as the only element of an array, so that text after the object makes it invalid
    body = F.regexp_extract("report", r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), MODEL)
    known = (F.col("body") != "") & (F.coalesce(F.size("parsed"), F.lit(0)) == 1)
    issues = F.transform(F.coalesce(F.get("parsed", F.lit(0))["issues"], F.array().cast(
        f"array<{MODEL_ISSUE}>")),
        lambda i: F.struct(i["file"].alias("path"), i["line"].try_cast("int").alias("line"),
                           i["type"].alias("type"), i["severity"].alias("severity"),
                           i["issue"].alias("issue"), i["code_snippet"].alias("code_snippet")))
    rows = responses.withColumns({"body": body, "parsed": parsed})
    return rows.select(
        "repo_id", "report_id",
        F.posexplode(F.when(known, issues).otherwise(prose_findings(F.col("report"))))
        .alias("rule", "r"),
    ).select("repo_id", "report_id", "rule", "r.*", F.lit(R.RANKS["model"]).alias("rank"),
             F.lit("model").alias("tool"))


def cap_findings(rows: DataFrame, limit: int = TOOL_LIMIT) -> DataFrame:
    """The first ``limit`` rows of each repository in report order."""
    return top_per_group(rows, ["repo_id"], ["report_id", "rule"], limit).drop("rn")


def snippet_lookup(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``code_snippet``, the stripped text of the named line or ''; a snippet
    that is there already stays.  ``rows`` is read twice: pass a written table.

    The line numbers wanted of a file are brought together first, so a file is joined
    and split once, however many findings name it, and no finding carries a file.  Findings
    from a model's prose all name one file that hardly any repository has; those of
    repositories without it take no part in the joins."""
    # linters give whole paths below the root; a model's leading slash leads out of it
    outside = (F.col("tool") == "model") & F.col("path").startswith("/")
    keyed = rows.withColumns({"_path": F.when(~outside, F.ltrim("path", F.lit("/"))),
                              "_line": F.coalesce("line", F.lit(1))})
    prose, lonely = F.coalesce(F.col("_path") == PROSE_FILE, F.lit(False)), None
    having = cut(files.where(F.col("path") == PROSE_FILE).select("repo_id").distinct(), "having")  # its size is known
    if having.isEmpty():
        keyed, lonely = keyed.where(~prose), keyed.where(prose)
    else:
        nowhere = keyed.where(prose).join(having, "repo_id", "left_anti")
        keyed, lonely = keyed.where(~prose).unionByName(keyed.where(prose).join(having, "repo_id", "left_semi")), nowhere
    wanted = keyed.where(F.col("_path").isNotNull()).groupBy("repo_id", "_path").agg(
        F.collect_set("_line").alias("_wanted"))
    texts = files.select("repo_id", F.col("path").alias("_path"), F.col("content").alias("_content"))
    lines = F.split(T.unify_newlines(F.col("_content")), "\n", -1)
    # the explode of one element keeps the split out of the lambda below
    split = texts.join(wanted, ["repo_id", "_path"]).select(
        "repo_id", "_path", "_wanted", F.explode(F.array(lines)).alias("_lines"))
    found = split.select("repo_id", "_path", F.explode(F.transform("_wanted", lambda n: F.struct(
        n.alias("_line"), T.strip(F.when(n >= 1, F.get("_lines", n - 1))).alias("_found")))).alias("f"))
    snippet = F.col("_found")
    if "code_snippet" in rows.columns:
        snippet = F.coalesce("code_snippet", snippet)
    looked_up = keyed.join(found.select("repo_id", "_path", "f.*"), ["repo_id", "_path", "_line"], "left")
    return (looked_up.unionByName(lonely.withColumn("_found", F.lit(None).cast("string")))
            .withColumn("code_snippet", F.coalesce(snippet, F.lit("")))
            .drop("_path", "_line", "_found"))
