"""Mixing sources to target weights by hash-threshold histograms.

A source with target T and size S takes each document floor(T / S) times and one more time those
whose hash lies below the source's threshold.  The threshold comes from sums per source and hash
bucket: the running sum finds the bucket in which the budget ends, and only that bucket is split
into finer ones, until it holds a single hash value.  No document is sorted; each round reads one
narrow table and returns at most BUCKETS rows per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftlake.llm.common import SPACE, fresh, text_of
from siftlake.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document or a source may be repeated
SEED = "mix"
BITS = 60
LEVEL_BITS = 12  # a histogram has 2**LEVEL_BITS buckets per source


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACE[1:-1]}]+")).cast("long")


def hash_of(id_col: str, seed: str = SEED) -> Column:
    """60 bits that depend on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target.  The sum of all sizes is shared by weight; a source whose
    share is above ``most`` times its size gets that, and the excess goes to the others by weight
    until none is above.  In the order of most * size / weight the capped sources come first, so
    one running sum over the sources settles it."""
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward, all_rows = by_room.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * most)
            .withColumn("room", F.col("cap").cast("double") / F.col("weight")))
    left = F.sum("source_size").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / F.sum("weight").over(onward))
    # the first source that keeps its whole share fixes the level for all after it
    free = F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "place", "level"))).over(
        Window.partitionBy(F.lit(1)))
    capped = free.isNull() | (F.struct("room", "place") < F.struct(free["room"], free["place"]))
    return rows.withColumn("capped", capped).withColumn("share", free["level"]).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("share")).alias("target"))


def _thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: source_size, target, times (whole copies) and below: documents with a smaller
    hash get one more.  ``base`` is the lower end of the bucket that still holds the budget's end,
    ``used`` what lies below it."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = (goals.withColumn("times", times.cast("long"))
             .withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
             .withColumn("base", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long")))
    for level in range(BITS // LEVEL_BITS):
        width = 1 << (BITS - LEVEL_BITS * (level + 1))
        state = cut(state, "state")
        ends = state.select(F.col("source").alias("s"), "base")
        slot = F.floor((F.col("h") - F.col("base")) / F.lit(width)).cast("long")
        sums = (sizes.join(ends, sizes.source.eqNullSafe(F.col("s")))
                .where((F.col("h") >= F.col("base")) & (F.col("h") < F.col("base") + F.lit(width << LEVEL_BITS)))
                .groupBy("s", slot.alias("slot")).agg(F.sum("size").alias("amount")))
        running = Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("amount").over(running))
        reached = sums.join(state.select(F.col("source").alias("s2"), "budget", "used"), F.col("s").eqNullSafe(F.col("s2")))
        # the last level decides for whole hash values: the one that crosses counts if that is nearer
        fits = F.col("used") + F.col("upto") <= F.col("budget")
        if width == 1:
            fits = F.col("used") + F.col("upto") - F.col("amount") / 2 <= F.col("budget")
        passed = (reached.groupBy("s").agg(
            F.min(F.when(~fits, F.struct("slot", (F.col("upto") - F.col("amount")).alias("below")))).alias("hit"),
            F.max("slot").alias("last"), F.sum("amount").alias("whole")))
        nothing = F.col("hit").isNull()
        state = (state.join(passed, state.source.eqNullSafe(F.col("s")), "left")
                 .withColumn("base", F.col("base") + F.when(F.col("whole").isNull(), F.lit(0)).when(
                     nothing, (F.col("last") + (1 if width == 1 else 0)) * F.lit(width)).otherwise(F.col("hit.slot") * F.lit(width)))
                 .withColumn("used", F.col("used") + F.when(F.col("whole").isNull(), F.lit(0)).when(
                     nothing, F.lit(0)).otherwise(F.col("hit.below")))
                 .select(*goals.columns, "times", "budget", "base", "used"))
    return cut(state.select(*goals.columns, "times", F.col("base").alias("below")), "state")


def _sized(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       words(text).alias("size"), hash_of(id_col).alias("h"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times, taken.

    Texts without words have size 0 and are taken no time; a null source is a source of its own, the last one.
    Repeated rows share their hash and are taken alike."""
    sizes = cut(_sized(docs, id_col, source, text), "sizes")
    limits = _thresholds(sizes, targets(sizes)).withColumnRenamed("source", "s")
    times = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.col("times") + F.when(F.col("h") < F.col("below"), F.lit(1)).otherwise(F.lit(0))).cast("long")
    return (sizes.join(limits, sizes.source.eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")))


def take_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns kept.  Texts without words
    are not taken; columns may have any names."""
    sizes = cut(_sized(docs, id_col, source, text), "sizes")
    of, whole, below, copy = fresh(docs, "_mix_source", "_mix_times", "_mix_below", "_mix_copy")
    limits = _thresholds(sizes, targets(sizes)).select(F.col("source").alias(of), F.col("times").alias(whole), F.col("below").alias(below))
    rows = docs.join(limits, docs[source].cast("string").eqNullSafe(F.col(of)))
    times = F.when(words(text) == 0, F.lit(0)).otherwise(
        F.col(whole) + F.when(hash_of(id_col) < F.col(below), F.lit(1)).otherwise(F.lit(0)))
    return (rows.withColumn(copy, F.explode(F.sequence(F.lit(0), times.cast("int"))))
            .where(F.col(copy) > 0).select(*[F.col(f"`{c}`") for c in docs.columns]))
