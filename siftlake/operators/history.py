"""The scan-history table: one row per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.operators.findings import top_per_group
from siftlake.session import fresh_path

# Columns that an update of a known job overwrites; the others keep their first value.
KEPT = ("user_id", "repo_url", "created_at")
UPDATED = ("status", "total_issues", "security_issues", "quality_issues", "files_scanned",
           "directories_scanned", "issues", "unit_test_report", "updated_at", "completed_at")
COUNTERS = ("total_issues", "security_issues", "quality_issues", "files_scanned",
            "directories_scanned")
LISTED = ("job_id", "repo_url", "status", *COUNTERS, "created_at", "completed_at")
LIST_LIMIT = 50


# How far a job has come.
STATES = {"queued": 0, "running": 1, "completed": 2, "failed": 2}


def event_order(time: str = "updated_at", event: str = "event_id") -> tuple[Column, ...]:
    """Order of a job's events: time, then state, then event."""
    state = F.expr("CASE status " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in STATES.items()) + " ELSE -1 END")
    return F.col(time).alias("time"), state.alias("state"), F.col(event).alias("event")


def last_per_job(rows: DataFrame, order=("updated_at",)) -> DataFrame:
    """Fold several writes of a job to one row: first values of the kept columns, last
    of the others.  An aggregate, so a job with very many writes is combined early."""
    at = F.struct(*order)
    kept = [c for c in rows.columns if c in KEPT]
    updated = [c for c in rows.columns if c in UPDATED]
    return rows.groupBy("job_id").agg(
        F.min_by(F.struct(*kept), at).alias("first"), F.max_by(F.struct(*updated), at).alias("last"),
    ).select("job_id", "first.*", "last.*")


def upsert_scans(base: DataFrame, updates: DataFrame, order=("updated_at",)) -> DataFrame:
    """Insert new jobs; for known ones overwrite all but owner, address and
    creation time."""
    new = last_per_job(updates, order)
    b, u = base.alias("b"), new.alias("u")
    known, touched = F.col("b.job_id").isNotNull(), F.col("u.job_id").isNotNull()
    columns = [F.coalesce("b.job_id", "u.job_id").alias("job_id")]
    for name in base.columns:
        if name in KEPT:
            columns.append(F.when(known, F.col(f"b.{name}")).otherwise(F.col(f"u.{name}")).alias(name))
        elif name != "job_id":
            columns.append(F.when(touched, F.col(f"u.{name}")).otherwise(F.col(f"b.{name}")).alias(name))
    return b.join(u, F.col("b.job_id") == F.col("u.job_id"), "full_outer").select(columns)


def get_scan(scans: DataFrame, job_id: str, user_id: int | None = None) -> DataFrame:
    """Owner 0 or None means any."""
    rows = scans.where(F.col("job_id") == job_id)
    return rows.where(F.col("user_id") == user_id) if user_id else rows


def recent_scans(scans: DataFrame, user_id: int, limit: int = LIST_LIMIT) -> DataFrame:
    """E7 for one owner."""
    return (scans.where(F.col("user_id") == user_id)
            .orderBy(F.desc("created_at"), "job_id").limit(limit).select(*LISTED))


def recent_scans_by_owner(scans: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """E7 for all owners at once."""
    owned = scans.where(F.col("user_id").isNotNull())
    return top_per_group(owned, ["user_id"], [F.desc("created_at"), "job_id"], limit, "place").select(
        "user_id", "place", *LISTED)


def scan_history(scans: DataFrame, repo_url: str, user_id: int) -> DataFrame:
    """Newest first."""
    names = [c for c in LISTED if c != "repo_url"]
    return (scans.where((F.col("repo_url") == repo_url) & (F.col("user_id") == user_id))
            .orderBy(F.desc("created_at"), "job_id").select(*names))


def delete_scan(scans: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop the jobs of ``doomed`` (job_id, user_id) when the owner is right."""
    return scans.join(doomed.select("job_id", "user_id"), ["job_id", "user_id"], "left_anti")


def clear_scans(scans: DataFrame, user_id: int) -> DataFrame:
    """J5."""
    return scans.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def visible_scans(scans: DataFrame, user_id: int | None) -> DataFrame:
    """Guest scans are public, owned ones are for their owner."""
    owner = F.coalesce("user_id", F.lit(0))
    return scans.where((owner == 0) | (F.lit(user_id).isNotNull() & (owner == F.lit(user_id))))


def active_scans(scans: DataFrame) -> DataFrame:
    """G20."""
    return scans.agg(F.count_if(F.col("status") == "running").alias("active_scans"))


def scan_duration(started: Column, ended: Column) -> tuple[Column, Column]:
    """Seconds between two timestamps, as number and as text."""
    seconds = F.timestamp_diff("MICROSECOND", started, ended) / 1_000_000
    return seconds, F.concat(F.format_string("%.2f", seconds), F.lit("s"))


def write_version(scans: DataFrame, path: str) -> DataFrame:
    """Write a new version of the table, nested lists as JSON text.  Versions are
    new folders: what is being read is never overwritten."""
    text = {c: F.to_json(c) for c, t in scans.dtypes if c in ("issues", "unit_test_report")
            and t != "string"}
    scans.withColumns(text).write.mode("errorifexists").parquet(path)
    return scans.sparkSession.read.parquet(path)


def read_version(spark: SparkSession, path: str, issues: str, report: str) -> DataFrame:
    """Read a version back; no issues read as an empty list, no report as null."""
    rows = spark.read.parquet(path)
    parsed = F.coalesce(F.from_json("issues", issues), F.array().cast(issues))
    return rows.withColumns({"issues": parsed, "unit_test_report": F.from_json(
        F.when(F.col("unit_test_report") != "", F.col("unit_test_report")), report)})


def scan_store_rw(scans: DataFrame) -> DataFrame:
    """One round through the stored form."""
    types = dict(scans.dtypes)
    path = fresh_path(scans.sparkSession, "scans")
    write_version(scans, path)
    return read_version(scans.sparkSession, path, types["issues"], types["unit_test_report"])
