"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records over buckets that fit into memory, by a seeded hash of the record.
Pass 2 shuffles each bucket (Spark's ``shuffle`` of an array is a Fisher-Yates shuffle), so that the
buckets one after another are one random order of all records.  The order is cut into shards of
equal length, so the numbers of records differ by one at most (law ``rows``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siftlake.llm.common import fresh, text_of, unused
from siftlake.session import cut

BUCKET_SHARE = 64  # a bucket is this part of the memory that a task has; a few may meet in one task
LEAST_BUCKET, MOST_BUCKET = 4 << 20, 512 << 20


def bucket_size(spark: SparkSession) -> int:
    """Aimed-at bytes of a bucket: a task holds one bucket, sorts it and shuffles it."""
    memory = spark.conf.get("spark.executor.memory", "1g")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(memory.rstrip("bB")[-1].lower(), 20)
    whole = int(memory.rstrip("bB").rstrip("kKmMgGtT")) << unit
    share = whole // max(1, int(spark.conf.get("spark.executor.cores", "1"))) // BUCKET_SHARE
    return min(MOST_BUCKET, max(LEAST_BUCKET, share))


def record_size(text: str = "text") -> Column:
    return (F.octet_length(text_of(text)) + F.lit(8)).cast("long")


def _record_hash(docs: DataFrame, seed: str) -> Column:
    """Of all columns.  A null counts as different from an empty text."""
    parts = [F.to_json(F.struct(c)) if t.startswith(("struct", "array", "map", "variant")) else F.col(c).cast("string")
             for c, t in docs.dtypes]
    return F.xxhash64(F.lit(seed), *[F.coalesce(p, F.lit("\0")) for p in parts])


def _spread_copies(docs: DataFrame, key: str, size: Column, room: int) -> tuple[DataFrame, bool]:
    """``docs`` with column ``key``, the hash to scatter by.  Equal records have equal hashes, so a
    record repeated often enough to fill a bucket by itself is counted (with map-side combine) and
    its copies get numbers, which go into their hash."""
    heavy = cut(docs.groupBy(key).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
                .where((F.col("bytes") > room) & (F.col("n") > 1)).select(key), "heavy")
    if heavy.isEmpty():
        return docs, False
    (n,) = fresh(docs, "_n")
    one = docs.join(heavy, key, "left_semi").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(n))
    copies = (one.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n)))
              .withColumn(key, F.xxhash64(key, n)).drop(n))
    return docs.join(heavy, key, "left_anti").unionByName(copies), True


def shuffled(docs: DataFrame, text: str = "text", seed: int = 0, bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` in one random order, given by column ``position`` (0, 1, 2...) beside all its columns;
    a table that has a column of that name is refused.

    Buckets hold ``bucket_bytes`` on average, by default a share of a task's memory; a longer record
    makes its bucket longer.  There are as many partitions as buckets, whatever the layout of the table;
    Spark draws the shuffles of a partition from the seed and its number, one bucket after another in
    their order, and the records of a bucket are sorted before.  So the result depends on the records,
    the seed and the bucket size alone, also if a task runs again.  Records with columns of types without
    an order (maps, variants) are shuffled from their order of arrival."""
    unused(docs, "position")
    bucket_bytes = bucket_bytes or bucket_size(docs.sparkSession)
    key, bucket, row, n, at = fresh(docs, "_hash", "_bucket", "_row", "_n", "_at")
    size = F.octet_length(text_of(text)) + F.lit(8)
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    buckets = max(1, -(-total // bucket_bytes))
    rows, again = _spread_copies(docs.withColumn(key, _record_hash(docs, str(seed))), key, size, 2 * bucket_bytes)
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int"))
    if again:
        rows = cut(rows, "scattered")
    # few rows: one per bucket
    starts = (rows.groupBy(bucket).agg(F.count(F.lit(1)).alias(n)).select(bucket, (F.sum(n).over(
        Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).alias(n)))
    whole = (rows.repartition(buckets, bucket)
             .groupBy(bucket).agg(F.collect_list(F.struct(*docs.columns)).alias(row)).sortWithinPartitions(bucket))
    drawn = whole.select(bucket, F.shuffle(F.sort_array(row) if _sortable(docs) else F.col(row), seed).alias(row))
    return (drawn.join(starts, bucket)
            .select(n, F.posexplode_outer(row).alias(at, row)).where(F.col(at).isNotNull())
            .select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns],
                    (F.col(n) + F.col(at)).cast("long").alias("position")))


def _sortable(docs: DataFrame) -> bool:
    return not any("map<" in t or "variant" in t for _, t in docs.dtypes)


def shard(docs: DataFrame, shards: int, text: str = "text", seed: int = 0,
          bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1), ``slot``, the place within the shard from 0 on
    without gaps, and ``position``; a table that has one of these columns is refused.  Shard k holds the
    positions from ceil(k * rows / shards) on.  Null ids and texts are records like others, repeated rows
    are repeated records.  An empty table gives no rows."""
    unused(docs, "shard", "slot", "position")
    rows = docs.count()
    where = shuffled(docs, text, seed, bucket_bytes)
    number = F.expr(f"(position * {shards}L) div {max(rows, 1)}L")
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return (where.withColumn("shard", number.cast("int"))
            .withColumn("slot", (F.col("position") - first).cast("long")))


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text", seed: int = 0) -> None:
    """Write the shards as Parquet folders ``shard=k``; within a shard the rows follow ``slot``
    when they are read by it."""
    shard(docs, shards, text, seed).drop("position").write.partitionBy("shard").parquet(path)
