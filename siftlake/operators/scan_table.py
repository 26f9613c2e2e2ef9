"""The scan history as a versioned table that is changed in place.

A row lies in the partition that the hash of its job names.  A version is a manifest: for each
partition the folder that holds it.  A change reads and rewrites only the partitions it touches, into
a new folder, and then adds a manifest that names the new folder for these and the old ones for all
others.  Nothing is overwritten: a reader keeps the version it has opened, and any older version can
be opened again.  A manifest is one small file that appears when Spark commits it, so a version is
there as a whole or not at all; a change that fails leaves a folder that no manifest names.  Of two
writers of one version the second fails and starts again from the new version.

    path/data/<folder>/part=<n>/…      rows
    path/manifests/version=<v>/…       (part, folder)"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftlake.operators.history import upsert_scans
from siftlake.session import cut

PARTS = 64


class ScanTable:
    """A table of scans below ``path``; ``parts`` counts when it is created."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, parts: int = PARTS):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("job_id"), F.lit(self.parts)).cast("int").alias("part")

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        return sorted({r["version"] for r in self._manifests().select("version").distinct().collect()})

    def _manifests(self) -> DataFrame:
        found = self.spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
        try:
            return found.schema("version int, part int, folder string").parquet(f"{self.path}/manifests")
        except AnalysisException as error:  # no version yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "version int, part int, folder string")

    def _manifest(self, version: int | None) -> tuple[int, dict[int, str]]:
        """The version (the newest if None) and its folders; a version may have no rows at all."""
        rows = self._manifests()
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        if version is None:
            return 0, {}
        found = rows.where(F.col("version") == version).collect()
        if not found:
            raise ValueError(f"there is no version {version}")
        return version, {r["part"]: r["folder"] for r in found if r["folder"] is not None}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.path}/data/{folder}/part={part}" for part, folder in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default.  What is written later does not show in it."""
        return self._rows(self._manifest(version)[1])

    def _commit(self, version: int, folders: dict[int, str]) -> int:
        rows = [(version, part, folder) for part, folder in sorted(folders.items())] or [(version, -1, None)]
        (self.spark.createDataFrame(rows, "version int, part int, folder string").coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.path}/manifests/version={version}"))
        return version

    def _rewrite(self, change, touched: list[int] | None, version: int, folders: dict[int, str]) -> int:
        """A new version in which the rows of the ``touched`` parts (None: all) are ``change`` of them."""
        touched = sorted(folders) if touched is None else touched
        rows = change(self._rows({p: f for p, f in folders.items() if p in touched})).select(*self.schema.names)
        folder = uuid.uuid4().hex
        where = f"{self.path}/data/{folder}"
        # one file a part; an empty result writes no part at all
        rows.withColumn("part", self._part()).repartition(max(1, len(touched)), "part").write.partitionBy("part").parquet(where)
        filled = {r["part"] for r in self.spark.read.schema(StructType([*self.schema.fields, StructField("part", IntegerType())]))
                  .parquet(where).select("part").distinct().collect()}
        kept = {p: f for p, f in folders.items() if p not in touched}
        return self._commit(version + 1, kept | {p: folder for p in filled})

    def _touched_by(self, rows: DataFrame) -> list[int]:
        return [r["part"] for r in rows.select(self._part()).distinct().collect()]

    def upsert(self, updates: DataFrame, order=("updated_at",)) -> int:
        """J1 on the parts of the jobs in ``updates``; returns the new version.  No updates, no version."""
        updates = cut(updates, "updates")
        version, folders = self._manifest(None)
        touched = self._touched_by(updates)
        if not touched:
            return version
        return self._rewrite(lambda base: upsert_scans(base, updates, order), touched, version, folders)

    def replace(self, rows: DataFrame) -> int:
        """Whole rows, one per job, in place of those of their jobs."""
        rows = cut(rows.select(*self.schema.names), "rows")
        version, folders = self._manifest(None)
        touched = self._touched_by(rows)
        if not touched:
            return version
        return self._rewrite(lambda base: base.join(rows.select("job_id"), "job_id", "left_anti").unionByName(rows), touched, version, folders)

    def delete(self, doomed: DataFrame) -> int:
        """Drop the jobs of ``doomed`` (job_id, user_id) where the owner is right."""
        doomed = cut(doomed.select("job_id", "user_id").distinct(), "doomed")
        version, folders = self._manifest(None)
        touched = [p for p in self._touched_by(doomed) if p in folders]
        if not touched:
            return version
        return self._rewrite(lambda base: base.join(doomed, ["job_id", "user_id"], "left_anti"), touched, version, folders)

    def clear(self, user_id: int) -> int:
        """Drop all jobs of an owner; only parts that hold some are rewritten."""
        version, folders = self._manifest(None)
        own = F.col("user_id").eqNullSafe(F.lit(user_id))
        touched = self._touched_by(self._rows(folders).where(own)) if folders else []
        if not touched:
            return version
        return self._rewrite(lambda base: base.where(~own), touched, version, folders)
