"""The batch plans on arriving data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.operators.findings import gate_by_language, repo_gates, with_fix
from siftlake.operators.history import KEPT, UPDATED, event_order
from siftlake.operators.scan_table import ScanTable
from siftlake.plans.scan import own_findings
from siftlake.session import cut, fresh_path


def _run(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _file() -> Column:
    """Key of a file; repositories and paths may be null."""
    return F.sha2(F.to_json(F.struct("repo_id", "path")), 256)


def _latest(arrivals: DataFrame) -> DataFrame:
    """Per file its last arrival: file, repo_id, path, hash, batch."""
    return arrivals.groupBy("file").agg(F.max_by(F.struct("repo_id", "path", "hash", "batch"), "batch").alias("l")).select("file", "l.*")


def _changed(batch: DataFrame, arrivals: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The files of a batch that are new or have another content than at their last arrival, each once,
    and their keys.  Of different contents of one file in one batch that with the largest hash counts.
    Only keys are compared; contents stay where they are unless a file comes twice in the batch."""
    keyed = batch.withColumns({"file": _file(), "hash": F.sha2(F.coalesce("content", F.lit("")), 256)})
    keys = cut(keyed.groupBy("file", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("repo_id").alias("repo_id"),
                                                 F.first("path").alias("path")), "keys")
    chosen = keys.groupBy("file").agg(F.max_by(F.struct("repo_id", "path", "hash"), "hash").alias("k"), F.sum("n").alias("n"))
    chosen = chosen.select("file", "k.*", "n")
    if arrivals is not None:
        chosen = chosen.join(_latest(arrivals).select("file", "hash"), ["file", "hash"], "left_anti")
    chosen = cut(chosen, "chosen")
    rows = keyed.join(chosen.select("file", "hash"), ["file", "hash"], "left_semi")
    if not chosen.where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["file"])
    return rows.select(*batch.columns), chosen.drop("n")


def _arrivals(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """What earlier batches brought; a batch that runs again does not see itself."""
    try:
        rows = spark.read.schema("file string, repo_id string, path string, hash string, batch long").parquet(f"{out}/files")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("batch") < before)


def stream_findings(files: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """K1: findings of files as they arrive, gated and with fixes.  A file arrives whole, so each batch
    is the batch plan; a batch that is run again replaces its own folder.

    A file may come again.  If its content is the one last seen it is not scanned; if it has changed,
    the findings of its last arrival count and the older ones go.  A null or empty content leaves no
    findings.  Whether a repository has code of a language follows from the last arrivals of all its
    files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        changed, keys = _changed(batch, _arrivals(batch.sparkSession, out, batch_id))
        own_findings(changed).write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
        keys.write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")

    _run(files, write, checkpoint)
    return current_findings(files.sparkSession, out)


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """The findings of the last arrival of every file of a findings stream; none if nothing has arrived."""
    arrivals = _arrivals(spark, out, 1 << 62)
    if arrivals is None:
        none = spark.createDataFrame([], "repo_id string, path string, content string")
        return with_fix(gate_by_language(own_findings(none), repo_gates(none)))
    # written: small enough ones are broadcast, others joined by file
    last = cut(_latest(arrivals), "latest")
    rows = spark.read.parquet(f"{out}/findings").withColumn("file", _file()).withColumn("batch", F.col("batch").cast("long"))
    rows = rows.join(last.select("file", "batch"), ["file", "batch"], "left_semi").drop("file", "batch")
    return with_fix(gate_by_language(rows, cut(repo_gates(last), "gates")))


def _fold(rows: DataFrame, first_at: Column, last_at: Column) -> DataFrame:
    """First values of the kept columns, last of the others, and when those were."""
    kept = [c for c in rows.columns if c in KEPT]
    updated = [c for c in rows.columns if c in UPDATED]
    return rows.groupBy("job_id").agg(
        F.min_by(F.struct(*kept), first_at).alias("first"),
        F.max_by(F.struct(*updated), last_at).alias("last"),
        F.min(first_at).alias("first_at"), F.max(last_at).alias("last_at"),
    ).select("job_id", "first.*", "last.*", "first_at", "last_at")


def stream_scan_status(events: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """K2: status events to the scan table.  A batch adds one folded row per job it
    touches and rewrites nothing; the table is the fold of all batches.  Events follow
    their time, then their state, then ``event_id``, and folding keeps these, so late,
    equal or repeated ones give the same table in any order of batches."""
    at = F.struct(*event_order())

    def write(batch: DataFrame, batch_id: int) -> None:
        _fold(batch, at, at).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(events, write, checkpoint)
    return status_table(events.sparkSession, out)


def stream_scan_table(events: DataFrame, table: ScanTable, checkpoint: str) -> DataFrame:
    """K2 with state: the fold of each job is kept by Spark's state store, so a batch costs what its own
    events cost.  Jobs that a batch changes are replaced in the versioned table, in the parts that hold
    them.  Events may come late, twice and in any order; a batch that runs again replaces the same rows
    by the same rows.  State grows with the jobs and lies in the checkpoint."""
    at = F.struct(*event_order())

    def write(batch: DataFrame, batch_id: int) -> None:
        table.replace(batch)

    _run(_fold(events, at, at).drop("first_at", "last_at"), write, checkpoint, "update")
    return table.read()


def _folded(spark: SparkSession, *folders: str) -> DataFrame:
    rows = None
    for folder in folders:
        part = spark.read.parquet(folder)
        part = part.drop(*[c for c in ("batch",) if c in part.columns])
        rows = part if rows is None else rows.unionByName(part)
    return _fold(rows, F.col("first_at"), F.col("last_at"))


def status_table(spark: SparkSession, *folders: str) -> DataFrame:
    """One row per job from the folders of a status stream and of its compacted past."""
    return _folded(spark, *folders).drop("first_at", "last_at")


def compact_status(spark: SparkSession, into: str, *folders: str) -> None:
    """Fold ``folders`` into the new folder ``into``, one row per job, which then stands
    for them in ``status_table``.  What is read is never overwritten: the stream goes on
    into a folder of its own, and the old folders can be removed once nobody reads them."""
    _folded(spark, *folders).write.mode("errorifexists").parquet(into)


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet table ``name`` of a folder, a single file or a folder of part files, as they arrive."""
    # as a pattern of one name: a plain path would have to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/{{{name}}}")


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = fresh_path(spark, name)
    return f"{base}/out", f"{base}/state"
