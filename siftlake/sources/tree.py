"""Trees of files, listed and read on executors.

Spark's readers list a tree on the driver: it keeps an entry for every file and plans a task for a few of
them, so its memory grows with the tree.  Here folders are listed in tasks, one level of the tree a round;
the list is a written table, whose files are dealt to tasks that read them with ``pyarrow.fs``.  The driver
sees counts only.  What is listed, and what is a line, is as Spark's text reader has it."""

from __future__ import annotations

import os
import re
import sys
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlake.session import cut

PIECE_BYTES = 1 << 20  # of a file, read at a time
ROW_BYTES = 16 << 20  # of lines, from which a run of them ends
BATCH_BYTES = 4 << 20  # of rows that leave a worker together
BATCH_FILES = 10_000  # entries that leave a worker together
TASK_FILES = 10_000  # files that a task reads
TASK_BYTES = 8 << 20  # that are worth a task

_PATTERN = r"[{}\[\]*?\\]"  # marks of a pattern of paths
_UTF8_MARK = b"\xef\xbb\xbf"


def storage(url: str) -> tuple[pa.fs.FileSystem, str]:
    """The storage of an address that has its scheme, and the path there."""
    if url.startswith("file:"):
        return pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", url).rstrip("/")
    scheme, rest = re.sub("^s3[an]://", "s3://", url).split("://", 1)
    system, top = pa.fs.FileSystem.from_uri(f"{scheme}://{urllib.parse.quote(rest, safe='/:@')}")
    return system, top.rstrip("/")


def address(spark: SparkSession, root: str, extensions=None) -> str | None:
    """The whole address of the folder ``root``.  None if ``pyarrow.fs`` does not know its storage, or if
    it is no folder or a pattern: that is left to Spark's reader."""
    if re.search(_PATTERN, root) or any(re.search(_PATTERN + "|[,^]", e) for e in extensions or ()):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    url = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    try:
        system, top = storage(url)
        found = system.get_file_info(top or "/")
    except (OSError, ValueError, NotImplementedError, ImportError):
        return None
    return url if found.type == pa.fs.FileType.Directory else None


def packed_endings(spark: SparkSession) -> list[str]:
    """Ends of the names of files that Spark's readers unpack, zstd by their own means."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    kinds = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted({".zst", ".zstd"} | {jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(k, conf).getDefaultExtension() for k in kinds})


def _entries(system: pa.fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, size) of what lies in a folder; a folder has no size.  Links to nothing and names that are no UTF-8 are
    left out, as Spark's listing does."""
    if isinstance(system, pa.fs.LocalFileSystem):  # entry by entry, as a folder may hold any number
        with os.scandir(folder) as found:
            for x in found:
                try:
                    size = None if x.is_dir() else x.stat().st_size
                    x.name.encode()
                except (FileNotFoundError, UnicodeEncodeError):
                    continue
                yield x.name, size
    else:
        for x in system.get_file_info(pa.fs.FileSelector(folder)):
            if x.type != pa.fs.FileType.NotFound:
                yield x.base_name, None if x.type == pa.fs.FileType.Directory else x.size


def _shown(name: str, is_folder: bool) -> bool:
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if name.startswith(("_metadata", "_common_metadata")):
        return is_folder or not hidden
    return not (hidden or name.endswith("._COPYING_"))


def _list(url: str, extensions):
    """Function for ``mapInArrow``: (path below the root, size) of what is in each folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = storage(url)
        ends = tuple(extensions or ("",))

        def found() -> Iterator[tuple[str, int | None]]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    for name, size in _entries(system, f"{top}/{folder}"):
                        if _shown(name, size is None) and (size is None or (size and name.endswith(ends))):
                            yield f"{folder}/{name}" if folder else name, size

        def batch_of(rows) -> pa.RecordBatch:
            paths, sizes = zip(*rows)
            return pa.record_batch({"path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())})

        rows = []
        for row in found():
            rows.append(row)
            if len(rows) == BATCH_FILES:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return run


def listed(spark: SparkSession, url: str, extensions=None) -> DataFrame:
    """(path, size) of the files below a folder that are not empty; paths begin below it."""
    level, found = spark.createDataFrame([("",)], "path string").coalesce(1), []
    while True:
        rows = cut(level.mapInArrow(_list(url, extensions), "path string, size long"), "listed")
        found.append(rows.where("size IS NOT NULL"))
        folders = rows.where("size IS NULL").select("path")
        if not (count := folders.count()):
            break
        level = folders.repartition(min(count, 4 * spark.sparkContext.defaultParallelism))
    files = found[0]
    for more in found[1:]:
        files = files.union(more)
    return files


def _runs(file: pa.NativeFile, start: int, end: int, size: int, most: int) -> Iterator[list[bytes]]:
    """The lines that begin from ``start`` on and before ``end``, in runs of at most ``most``.  Lines end with
    \\n, \\r\\n or \\r, and the mark of UTF-8 before the first one is no text."""
    # the line that the byte before ``start`` belongs to began in the block before
    at = place = max(start - 1, 0)
    rest, skip, lines, held, ended = b"", start > 0, [], 0, False
    while place < end and not ended:
        # a long line is read in pieces that double
        ask = max(len(rest), min(PIECE_BYTES, size - at + 1) if at <= size else PIECE_BYTES)
        data = file.read_at(ask, at)
        at, ended = at + len(data), len(data) < ask
        pieces = (rest + data).splitlines(True)
        # \n may follow a last \r
        rest = pieces.pop() if pieces and not ended and not pieces[-1].endswith(b"\n") else b""
        for piece in pieces:
            if place >= end:
                break
            first, place = place == 0, place + len(piece)
            if skip:
                skip = False
                continue
            if first and piece.startswith(_UTF8_MARK):
                piece = piece[3:]
                if not piece:
                    continue
            line = piece.rstrip(b"\r\n")
            lines.append(line)
            held += len(line)
            if len(lines) == most or held >= ROW_BYTES:
                yield lines
                lines, held = [], 0
    if lines:
        yield lines


def _read(url: str, most: int):
    """Function for ``mapInArrow``: the runs of lines of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = storage(url)

        def batch_of(rows) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "block", "many", "run", "lines"])

        rows, held = [], 0
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "size"))):
                with system.open_input_file(f"{top}/{path}") as file:
                    for i, lines in enumerate(_runs(file, start, end, size, most)):
                        rows.append((path, start, start > 0 or end < size, i, lines))
                        held += sum(map(len, lines)) + 50 * len(lines)  # of an object
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def line_runs(spark: SparkSession, url: str, files: DataFrame, most: int) -> DataFrame:
    """(path, block, many, run, lines) of the ``files`` below ``url``: their bytes as runs of at most ``most``
    lines, numbered from 0 in each block.  A file is cut into blocks of the bytes that a task of Spark reads;
    ``many`` tells whether it has more than one."""
    block = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, size // max(block, TASK_BYTES) + 1, count // TASK_FILES + 1)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))
    blocks = files.select("path", "size", starts.alias("start")).select(
        "path", "start", F.least(F.col("start") + block, F.col("size")).alias("end"), "size")
    return blocks.repartition(tasks).mapInArrow(_read(url, most), "path string, block long, many boolean, run long, lines array<binary>")


# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
