"""Giant files over many tasks.

Comment and docstring state depend on neighbouring lines, so a file is normally worked out on its own
row.  A giant file is cut into chunks of lines instead.  What a chunk does to its neighbours is a few
characters, computed from the chunk alone:

* ``turns``: the comment state after the chunk for each of the three states before it, as a text of
  three digits (0 outside, 1 and 2 inside the first and second kind of block).  One chunk after
  another is ``translate(first, '012', second)``, which is associative;
* ``head``: the documentation letters of its first three lines, for those that look ahead;
* ``mark``: its first letter that settles an open function (a definition or a quote);
* ``n_lines``, and ``counted``, its lines without an empty remainder after the file's last line end.

A scan over a tree of FAN-wide nodes brings each chunk the state before it, its first line number and
the letters after it.  A node holds at most FAN small rows, so a file may have any number of chunks.
Then every chunk is a row that is worked out by itself, as a whole file is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.operators import lines as L
from siftlake.session import cut

CHUNK_BYTES = 1 << 20  # of a file, on average
GIANT_BYTES = 64 << 20  # from which a file is worth the second read
FAN = 64
SAME = "012"  # the turns of a chunk without marks

_FILE = ("repo_id", "path")


def split_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(repo_id, path, chunk, lines, counted): the lines of each file in chunks of ``chunk_bytes`` on
    average, one row each.  A null content has no line and no chunk."""
    text = T.unify_newlines(F.col("content"))
    rows = files.select(*_FILE, F.split(text, "\n", -1).alias("all"), F.octet_length("content").alias("bytes"))
    per_chunk = F.greatest(F.lit(1), F.floor(F.size("all") * F.lit(chunk_bytes) / F.greatest("bytes", F.lit(1)))).cast("int")
    rows = rows.where(F.col("all").isNotNull()).withColumn("step", F.least(per_chunk, F.size("all")))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / F.col("step")).cast("int"))
    return rows.select(*_FILE, F.posexplode(F.transform(
        starts, lambda i: F.slice("all", i * F.col("step") + 1, F.col("step")))).alias("chunk", "lines"), F.size(starts).alias("n")
    ).select(*_FILE, F.col("chunk").cast("long").alias("chunk"), "lines", (F.size("lines") - F.when(
        (F.col("chunk") + 1 == F.col("n")) & L.last_line_is_empty(F.col("lines")), 1).otherwise(0)).cast("long").alias("counted"))


def _kinds(ext: Column) -> tuple[Column, Column, Column]:
    return (T.has_extension(ext, R.TRIPLE_QUOTE_EXTENSIONS), T.has_extension(ext, R.BLOCK_COMMENT_EXTENSIONS), ext == ".py")


def _after(letters: Column, opener: str) -> Column:
    """The state after ``letters``, entered by ``opener``: what is left when all closed runs and all
    that lies outside of runs is taken away begins with the mark of the open run, if any."""
    rest = F.regexp_replace(F.concat(F.lit(opener), letters), L.CLOSED_RUNS, "")
    return F.when(rest.startswith("s"), "2").when(rest.startswith("d") | rest.startswith("o"), "1").otherwise("0")


def summaries(chunks: DataFrame) -> DataFrame:
    """(repo_id, path, chunk, n_lines, counted, turns, head, mark) per chunk, from the chunk alone."""
    ext = T.file_ext(F.col("path"))
    quotes, blocks, python = _kinds(ext)
    rows = chunks.select(*_FILE, "chunk", F.size("lines").cast("long").alias("n_lines"), "counted",
                         F.when(quotes, L.quote_letters(F.col("lines"))).when(blocks, L.block_letters(F.col("lines"))).alias("letters"),
                         F.when(python, L.documentation_letters(F.col("lines"))).alias("doc"), quotes.alias("quotes"))
    letters = F.col("letters")
    two = F.concat(_after(letters, ""), _after(letters, "d"), _after(letters, "s"))
    one = F.concat(_after(letters, ""), _after(letters, "o"), F.lit("2"))
    own = F.when(letters.rlike("[odscDS]"), F.when(F.col("quotes"), two).otherwise(one))
    return rows.select(*_FILE, "chunk", "n_lines", "counted", F.coalesce(own, F.lit(SAME)).alias("turns"),
                       F.coalesce(F.left("doc", F.lit(3)), F.lit("")).alias("head"),
                       F.coalesce(F.regexp_extract("doc", "[fgq]", 0), F.lit("")).alias("mark"))


def _then(first: Column, second: Column) -> Column:
    """First one turn, then the other."""
    return F.call_function("translate", first, F.lit(SAME), second)


def _same_file(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """``left`` joined by file and ``more``; repositories and paths may be null."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in (*_FILE, *more)})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_of_{c}"]) for c in _FILE] + [left[c] == renamed[f"_of_{c}"] for c in more])
    return left.join(renamed, same).drop(*[f"_of_{c}" for c in (*_FILE, *more)])


def _gathered(nodes: DataFrame) -> DataFrame:
    """Up to FAN nodes under one, in order."""
    one = F.struct("at", "n_lines", "counted", "turns", "head", "mark")
    return nodes.groupBy(*_FILE, F.floor(F.col("at") / FAN).alias("up")).agg(F.sort_array(F.collect_list(one)).alias("nodes"))


def _joined(part: str, size: int) -> Column:
    return F.left(F.array_join(F.col(f"nodes.{part}"), ""), F.lit(size))


def _summed(part: str) -> Column:
    return F.aggregate(F.col(f"nodes.{part}"), F.lit(0).cast("long"), lambda a, x: a + x)


def places(summary: DataFrame) -> DataFrame:
    """(repo_id, path, chunk, first_line, file_lines, state, after_head, after_mark) per chunk: an
    exclusive scan, up and down a tree of FAN-wide nodes."""
    level = cut(summary.withColumnRenamed("chunk", "at"), "level")
    most, levels = level.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0], []
    while most > 0 or not levels:
        levels.append(cut(_gathered(level), "nodes"))
        level = levels[-1].select(
            *_FILE, F.col("up").alias("at"),
            _summed("n_lines").alias("n_lines"), _summed("counted").alias("counted"),
            F.aggregate("nodes", F.lit(SAME), lambda a, x: _then(a, x.turns)).alias("turns"),
            _joined("head", 3).alias("head"), _joined("mark", 1).alias("mark"))
        most //= FAN
    # before the whole file is the state outside, behind it is nothing
    known = level.select(*_FILE, "at", F.lit("0").alias("state"), F.lit(1).cast("long").alias("first_line"),
                         F.col("counted").alias("file_lines"), F.lit("").alias("after_head"), F.lit("").alias("after_mark"))
    for nodes in reversed(levels):
        start = F.struct(F.col("state").alias("state"), F.col("first_line").alias("first_line"),
                         F.array().cast("array<struct<at:bigint,state:string,first_line:bigint>>").alias("out"))
        before = F.aggregate("nodes", start, lambda a, x: F.struct(
            _then(a.state, x.turns).alias("state"), (a.first_line + x.n_lines).alias("first_line"),
            F.array_append(a.out, F.struct(x["at"].alias("at"), a.state.alias("state"), a.first_line.alias("first_line"))).alias("out"))).out
        rows = _same_file(nodes, known.withColumnRenamed("at", "up"), "up").withColumn("before", before)
        rows = rows.select(*_FILE, "file_lines", "nodes", "after_head", "after_mark", F.posexplode("before").alias("i", "b"))

        def later(part: str, outer: str, size: int) -> Column:
            rest = F.slice(F.col(f"nodes.{part}"), F.col("i") + 2, F.size("nodes"))
            return F.left(F.concat(F.array_join(rest, ""), F.col(outer)), F.lit(size))

        known = cut(rows.select(*_FILE, "b.at", "b.state", "b.first_line", "file_lines", later("head", "after_head", 3).alias("after_head"),
                                later("mark", "after_mark", 1).alias("after_mark")), "known")
    return known.withColumnRenamed("at", "chunk")


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in the file.  They are written once, spread by file and number, and
    read twice: for their summaries and for the work itself."""
    written = cut(chunks.repartition(*_FILE, "chunk"), "chunks")
    return _same_file(written, places(summaries(written)), "chunk")


def annotated_chunks(placed: DataFrame, comments: bool = True, docs: bool = True, carry: dict | None = None,
                     whole=None, explode: bool = True) -> DataFrame:
    """The lines of :func:`placed_chunks`, as :func:`siftlake.operators.lines.annotated_lines` has them."""
    text = F.array_join("lines", "\n")
    return L.annotated(placed.withColumns({
        "ext": T.file_ext(F.col("path")), "has_quotes": text.contains(L.DQ) | text.contains(L.SQ),
        "has_block": text.contains("/*"), "has_names": text.contains("def") | text.contains("class")}), comments, docs, carry, True, whole, explode)
