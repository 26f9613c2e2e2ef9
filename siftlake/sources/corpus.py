"""The file corpus: reading, choosing and measuring files."""

from __future__ import annotations

import os
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.operators.matching import pruned
from siftlake.session import cut, fresh_path
from siftlake.sources import tree

# Limits of a standard and a deep scan.
FILE_BYTES = {False: 20_000, True: 100_000}
PAYLOAD_CHARS = {False: 100_000, True: 500_000}

PACKED_FILES = 1_000  # that Spark's reader is given at a time


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def below(path: Column, root: str) -> Column:
    """The path of a listed file below ``root``: a listing gives whole addresses, perhaps with a scheme."""
    top = re.sub("/+", "/", re.sub(_SCHEME, "", root)).rstrip("/")
    if top and not top.startswith("/"):
        top = os.path.abspath(top)
    whole = F.regexp_replace(path, _SCHEME, "")
    return F.substring(whole, F.lit(len(top) + 2), F.length(whole))


def read_tree(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """A1: files below ``root/<repository>/``, filtered by name at the source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    relative = below(F.col("path"), root)
    return reader.load(root).select(
        F.substring_index(relative, "/", 1).alias("repo_id"),
        F.element_at(F.split(relative, "/", 2), 2).alias("path"),
        T.decode_text(F.col("content")).alias("content"),
        F.col("length").alias("size_bytes"),
    )


def _runs_by_spark(spark: SparkSession, paths, root: str, extensions, chunk_lines: int) -> DataFrame:
    """(file, path, block, many, run, lines) of the files that Spark's text reader finds at ``paths`` below ``root``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), T.decode_text(F.col("value").cast("binary")).alias("raw"))
    # rows of a block follow each other in one task, and so do their numbers
    parts = rows.groupBy("file", "block", F.floor(F.col("at") / chunk_lines).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("rows"))
    path = below(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), root)
    return parts.select("file", path.alias("path"), "block", F.lit(True).alias("many"), "run", F.col("rows.raw").alias("lines"))


def _packed_runs(spark: SparkSession, url: str, files: DataFrame, chunk_lines: int) -> DataFrame | None:
    """The same for ``files`` that Spark's reader unpacks, some at a time, as it keeps what it reads on the driver."""
    if not (count := files.count()):
        return None
    to, paths = fresh_path(spark, "packed"), []

    def write() -> None:
        _runs_by_spark(spark, paths, url, None, chunk_lines).write.mode("append").parquet(to)
        paths.clear()

    for row in files.select("path").repartition(count // PACKED_FILES + 1).toLocalIterator():
        paths.append(f"{url}/" + re.sub(r"([{}\[\]*?\\])", r"\\\1", row.path))
        if len(paths) == PACKED_FILES:
            write()
    if paths:
        write()
    return spark.read.parquet(to)


def read_line_blocks(spark: SparkSession, root: str, extensions=None, chunk_lines: int = 20_000) -> DataFrame:
    """(repo_id, path, chunk, lines, counted) of files below ``root/<repository>/`` that are too large
    for one row: a file is split into blocks of bytes, and runs of at most ``chunk_lines`` lines of a
    block become the chunks.  Line ends may be \\n, \\r\\n or \\r.  Lines are those of a
    reader that goes line by line: no empty remainder after the last line end.

    Files are listed and read on executors (:mod:`siftlake.sources.tree`), and the driver keeps none of them.  A root
    that is a pattern, no folder, or in a storage that ``pyarrow.fs`` does not know is read by Spark's text reader, which
    lists it on the driver; so are packed files, some at a time."""
    if url := tree.address(spark, root, extensions):
        files = tree.listed(spark, url, extensions)
        is_packed = reduce(or_, [F.col("path").endswith(e) for e in tree.packed_endings(spark)])
        runs = tree.line_runs(spark, url, files.where(~is_packed), chunk_lines)
        parts = cut(runs.select(F.col("path").alias("file"), "path", "block", "many", "run",
                                F.transform("lines", T.decode_text).alias("lines")), "blocks")
        packed = _packed_runs(spark, url, files.where(is_packed), chunk_lines)
        parts = parts if packed is None else parts.union(packed)
    else:
        parts = cut(_runs_by_spark(spark, root, root, extensions, chunk_lines), "blocks")
    # only a file of many blocks needs its runs numbered; those of a single block have their numbers
    order = Window.partitionBy("file").orderBy("block", "run")  # narrow rows
    numbers = cut(parts.where("many").select("file", "block", "run").withColumn(
        "chunk", (F.row_number().over(order) - 1).cast("long")), "numbers")
    return parts.join(numbers, ["file", "block", "run"], "left").select(
        F.substring_index("path", "/", 1).alias("repo_id"), F.element_at(F.split("path", "/", 2), 2).alias("path"),
        F.coalesce("chunk", "run").alias("chunk"), "lines", F.size("lines").cast("long").alias("counted"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A1: a parquet table (repo_id, path, content)."""
    return spark.read.parquet(path)


def with_extensions(files: DataFrame, extensions) -> DataFrame:
    return files.where(T.has_extension(F.col("path"), extensions))


def prune_dirs(files: DataFrame, names=R.VENDORED_DIRS) -> DataFrame:
    """A2."""
    return files.where(~pruned(F.col("path"), names))


def visible(files: DataFrame) -> DataFrame:
    """Files that a listing shows: not hidden, not below an ignored directory."""
    return prune_dirs(files, R.IGNORED_DIRS).where(~T.file_name(F.col("path")).startswith("."))


def drop_blank_files(files: DataFrame) -> DataFrame:
    """C5."""
    return files.where(T.strip(F.col("content")) != "")


def size_ok(files: DataFrame, deep: bool = False) -> Column:
    """On the bytes of the file, which the source tells or the content has."""
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    return size <= FILE_BYTES[deep]


def max_file_size(files: DataFrame, deep: bool = False) -> DataFrame:
    return files.where(size_ok(files, deep))


def payload_files(files: DataFrame, deep: bool = False) -> DataFrame:
    return drop_blank_files(max_file_size(with_extensions(files, R.PAYLOAD_EXTENSIONS), deep))


def payload_sizes(files: DataFrame, deep: bool = False) -> DataFrame:
    """Files that may go to a model, with their characters; no content."""
    return payload_files(files, deep).select("repo_id", "path", F.char_length(T.unify_newlines(F.col("content")))
                       .cast("long").alias("chars"))


def prompt_text(files: DataFrame, kept: DataFrame, limit: int = 1000, deep: bool = False) -> DataFrame:
    """One text per repository from the files that the budget kept.  The budget
    bounds what is collected per repository; only the head of a file is shuffled."""
    content = T.unify_newlines(F.col("content"))
    clipped = F.when(F.char_length(content) > limit,
                     F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)
    block = F.concat(F.lit("\n=== "), F.col("path"), F.lit(" ===\n"), clipped, F.lit("\n"))
    heads = payload_files(files, deep).select("repo_id", "path", block.alias("block"))
    blocks = heads.join(kept.select("repo_id", "path"), ["repo_id", "path"]).select(
        "repo_id", F.struct("path", "block").alias("part"))
    return blocks.groupBy("repo_id").agg(
        F.concat(F.lit("Repository: "), F.first("repo_id"), F.lit("\n\nCode files to analyze:\n"),
                 F.array_join(F.array_sort(F.collect_list("part"))["block"], "")).alias("prompt"))
