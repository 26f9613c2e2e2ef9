"""Exact duplicates by a tree of merges over sorted runs of digests.

Every document has a digest of its normalised text and belongs to one of R runs, by a hash of its
id.  A run keeps one row per digest: the best row so far and how many rows it stands for.  In each
round the runs whose numbers agree but for their lowest base-k digit meet, so k sorted runs are
merged into one, until a single logical run is left.  All runs, at every level, are spread over
all partitions by (run, digest), so no task holds a whole run, and a digest shared by a third of
all rows arrives as at most k rows per group.  The answer goes back down the same tree: each level
looks up its parent, again at most k rows per key, and at last each document its own run.

Two texts count as equal when SHA-256, an independent 64-bit hash and the byte length of the
normalised texts all agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm.common import SPACE, fresh, shuffle_partitions, text_of
from siftlake.session import cut

FAN_IN = 8
_KEY = ["digest", "check", "n_bytes"]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), f"{SPACE}+", "")


def _digest_columns(text: str) -> list[Column]:
    plain = normalised(text)
    return [F.unhex(F.sha2(plain, 256)).alias("digest"), F.xxhash64(plain).alias("check"),
            F.octet_length(plain).cast("long").alias("n_bytes")]


def _digests(docs: DataFrame, id_col: str, text: str, runs: int) -> DataFrame:
    """One row per different (id, text): its run, its digest and ``copies``, the repeated rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_digest_columns(text),
                       F.char_length(text_of(text)).cast("long").alias("points"))
    return (rows.groupBy("doc_id", *_KEY, "points").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")))


def _merge(runs: DataFrame) -> DataFrame:
    """One row per run and digest.  The smallest ``best`` wins: most code points, then the
    smallest id, an id of null last."""
    return runs.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def _parent(fan_in: int) -> Column:
    return F.floor(F.col("run") / fan_in).cast("int")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     fan_in: int = FAN_IN, runs: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, points.

    A null text is an empty one; empty texts equal each other.  Of repeated rows with one id and
    one text exactly one has ``kept``.  Ids of null lose against any other id."""
    runs = runs or shuffle_partitions(docs.sparkSession)
    rows = cut(_digests(docs, id_col, text, runs), "digests")
    best = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"),
                    F.col("doc_id").alias("id"))
    levels = [cut(_merge(rows.select("run", *_KEY, best.alias("best"), F.col("copies").alias("rows"))), "run")]
    while runs > 1:
        levels.append(cut(_merge(levels[-1].withColumn("run", _parent(fan_in))), "run"))
        runs = -(-runs // fan_in)
    found = levels.pop()
    for level in reversed(levels):
        found = (level.select("run", *_KEY).withColumn("own", F.col("run")).withColumn("run", _parent(fan_in))
                 .join(found, ["run", *_KEY]).withColumn("run", F.col("own")).drop("own"))
    joined = rows.join(found, ["run", *_KEY])
    wins = F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("points") == F.col("best.less"))
    return (joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", F.col("best.id").alias("keep_id"), F.col("rows").cast("long").alias("group_size"),
                    (wins & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "points"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept documents with all their columns, which may have any names.  Also of repeated rows one
    stays.  Texts are moved once: the aggregate that drops repeated rows has the keys of the join."""
    key, points, name = own = fresh(docs, "_sha", "_points", "_name")
    kept = duplicate_groups(docs, id_col, text).where("kept").select(
        _name_of("doc_id").alias("id"), "text_sha256", "points")
    tagged = docs.withColumns({key: F.sha2(normalised(text), 256), points: F.char_length(text_of(text)).cast("long"),
                               name: _name_of(id_col)})
    right = dict(zip(own, fresh(tagged, "_sha2", "_points2", "_name2")))
    kept = cut(kept.select(F.col("id").alias(right[name]), F.col("text_sha256").alias(right[key]), F.col("points").alias(right[points])),
               "kept")
    hits = tagged.join(kept, [F.col(a) == F.col(b) for a, b in right.items()])
    return hits.dropDuplicates(own).select(*[F.col(f"`{c}`") for c in docs.columns])


def _name_of(id_col: str) -> Column:
    """The id as text; a null id has a name of its own."""
    return F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
