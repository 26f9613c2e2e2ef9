"""What several operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


ROWS = 1_000  # documents that go to a Python worker at a time


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Rows of documents are wide: let at most ``rows`` of them go to a Python worker at a time, in
    this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unused(df: DataFrame, *names: str) -> None:
    """Refuse a table that already has a column which an operator is about to add."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {', '.join(sorted(clash))}; rename it or name another one")


def ship(module: str) -> None:
    """Send the module's functions to Python workers with the job, so that executors need not have
    this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
