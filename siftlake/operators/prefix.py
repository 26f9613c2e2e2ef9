"""Running totals and numbers within a key, whatever the size of the key.

A window over a key puts the whole key into one task.  Here the rows are range
sorted by key and order, so that a large key covers many partitions; the totals per
partition are few and give each partition its start."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siftlake.session import cut

_SLOT = "_slot"


def _ordered(df: DataFrame, keys, order) -> DataFrame:
    """Rows with an increasing ``_slot`` whose upper bits are the partition.

    A range sort reads its input twice, to sample and to sort, so the input is cut
    first; the second cut fixes partitions and slots for every later read."""
    rows = cut(df, "unsorted")
    return cut(rows.orderBy(*keys, *order).withColumn(_SLOT, F.monotonically_increasing_id()), "sorted")


def _starts(rows: DataFrame, keys, totals: dict) -> DataFrame:
    """Per key and partition: for each total, what the partitions before it add up to."""
    earlier = (Window.partitionBy(*keys).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy(*keys, "_part").agg(
        F.min(_SLOT).alias("_first"), *[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    return sums.select(*keys, "_part", "_first", *[
        F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in totals])


def _inside(keys, value: str):
    """What the rows before this one in its partition add up to."""
    earlier = (Window.partitionBy(*keys, "_part").orderBy(_SLOT)
               .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _with_starts(rows: DataFrame, starts: DataFrame, keys) -> DataFrame:
    """Keys may be null."""
    renamed = starts.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)} | {"_part": "_of"})
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(renamed, same).drop("_of", *[f"_key_{i}" for i in range(len(keys))])


_HELPERS = (_SLOT, "_part", "_first", "_start_rows", "_start_value")


def number_within(df: DataFrame, keys, order, name: str = "n", value: str | None = None) -> DataFrame:
    """1, 2, 3... within each key by ``order``; with ``value`` also ``before``, the sum
    of that column over the rows before."""
    rows = _ordered(df, keys, order).withColumn("_part", F.shiftright(_SLOT, 33))
    totals = {"rows": F.lit(1)}
    if value:
        totals["value"] = F.col(value)
    rows = _with_starts(rows, _starts(rows, keys, totals), keys)
    rows = rows.withColumn(name, F.col("_start_rows") + F.col(_SLOT) - F.col("_first") + 1)
    if value:
        rows = rows.withColumn("before", F.col("_start_value") + _inside(keys, value))
    return rows.drop(*_HELPERS)


def keep_while_before(df: DataFrame, keys, order, value: str, limit: int) -> DataFrame:
    """Rows whose predecessors within the key add up to at most ``limit``; adds that
    sum as ``before``.  Partitions that start beyond the limit drop out at once."""
    rows = _ordered(df, keys, order).withColumn("_part", F.shiftright(_SLOT, 33))
    starts = _starts(rows, keys, {"value": F.col(value)}).where(F.col("_start_value") <= limit)
    return (
        _with_starts(rows, starts, keys)
        .withColumn("before", F.col("_start_value") + _inside(keys, value))
        .where(F.col("before") <= limit)
        .drop(*_HELPERS)
    )


def size_budget(sizes: DataFrame, limit: int) -> DataFrame:
    """H1: files in path order until the one that makes the total exceed ``limit``."""
    return keep_while_before(sizes, ["repo_id"], ["path"], "chars", limit)
