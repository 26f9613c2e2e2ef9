"""Files to numbered lines, with comment state, without a shuffle.

A file is one row, so everything that depends on neighbouring lines is worked out
on the row's own array of lines before it is exploded.  Each line becomes one
letter that says what it means for the state, the letters of a file are joined to
one string, and a regular expression marks the runs.  That is linear in the file
and needs neither a window over all lines of the corpus nor a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake import rules as R
from siftlake.functions import text as T

DQ, SQ = '"""', "'''"

# Comment letters: o opens a block, c closes it, b does both; d/D is a line with
# one/many """, s/S one/many '''; a dot means nothing.  Runs between < and > are
# inside a comment; the line that closes a run is outside of it.
_INSIDE_RUNS = r"(o[^c]*|d[^dD]*|s[^sS]*)([cdDsS]?)|([^ods]+)"

# Whole runs, and what lies outside of runs.
CLOSED_RUNS = r"o[^c]*c|d[^dD]*[dD]|s[^sS]*[sS]|[^ods]+"

# Documentation letters: f/g function line without/with quotes, k/l class line
# without/with quotes, q other line with quotes.
_UNDOCUMENTED_CLASS = r"[kl](?!.{0,2}[glq])"
_UNDOCUMENTED_DEF = r"[fg](?=[^fgq]*[fg])"


def _block_letter(line: Column) -> Column:
    opens, closes = line.contains("/*"), line.contains("*/")
    return (F.when(opens & closes, "b").when(opens, "o").when(closes, "c").otherwise("."))


def _quote_letter(line: Column) -> Column:
    return (
        F.when(line.contains(DQ), F.when(line.rlike('"{3}.*"{3}'), "D").otherwise("d"))
        .when(line.contains(SQ), F.when(line.rlike("'{3}.*'{3}"), "S").otherwise("s"))
        .otherwise(".")
    )


# Python's white space at the start of a line.
_INDENT = r"(?U)^[\s\x1c-\x1f]*"


def _documentation_letter(line: Column) -> Column:
    quoted = line.contains(DQ) | line.contains(SQ)
    is_def = line.contains("def") & line.rlike(_INDENT + r"def\s+\w+\s*\(")
    is_class = line.contains("class") & line.rlike(_INDENT + r"class\s+\w")
    return (
        F.when(is_def, F.when(quoted, "g").otherwise("f"))
        .when(is_class, F.when(quoted, "l").otherwise("k"))
        .when(quoted, "q").otherwise(".")
    )


def _letters(lines: Column, letter) -> Column:
    return F.array_join(F.transform(lines, letter), "")


def quote_letters(lines: Column) -> Column:
    return _letters(lines, _quote_letter)


def block_letters(lines: Column) -> Column:
    return _letters(lines, _block_letter)


def documentation_letters(lines: Column) -> Column:
    return _letters(lines, _documentation_letter)


def _inside_flags(letters: Column) -> Column:
    """One '1' or '0' per letter: is the line inside a block?"""
    parts = F.split(F.regexp_replace(letters, _INSIDE_RUNS, "<$1>$2$3"), "[<>]", -1)
    runs = F.transform(parts, lambda part, i: F.repeat(
        F.when(i % 2 == 1, "1").otherwise("0"), F.length(part)))
    return F.split(F.array_join(runs, ""), "")


def _documentation_flags(letters: Column) -> Column:
    """'K' for a class and 'F' for a function that lacks its docstring."""
    marked = F.regexp_replace(letters, _UNDOCUMENTED_CLASS, "K")
    return F.split(F.regexp_replace(marked, _UNDOCUMENTED_DEF, "F"), "")


def split_lines(files: DataFrame) -> DataFrame:
    """Add ``ext`` and the array ``lines`` to a file table, and whether the file has
    any mark that the comment or the documentation state depends on."""
    content = F.col("content")
    return files.withColumns({
        "ext": T.file_ext(F.col("path")),
        "lines": F.split(T.unify_newlines(content), "\n", -1),
        "has_quotes": content.contains(DQ) | content.contains(SQ),
        "has_block": content.contains("/*"),
        "has_names": content.contains("def") | content.contains("class"),
    }).drop("content")


def last_line_is_empty(lines: Column) -> Column:
    return F.element_at(lines, -1) == ""


def explode_lines(files: DataFrame, iterate: bool = False) -> DataFrame:
    """B1: (repo_id, path, ext, line, raw).  ``iterate`` leaves out the empty
    remainder after a final line break, as reading a file line by line does."""
    # counted before the explode, so that no line row carries its file's array along
    arrays = split_lines(files).select("repo_id", "path", "ext", "lines", F.size("lines").alias("n"))
    rows = arrays.select(
        "repo_id", "path", "ext", "n", F.posexplode_outer("lines").alias("pos", "raw")).where("pos IS NOT NULL")
    if iterate:
        rows = rows.where((F.col("pos") + 1 < F.col("n")) | (F.col("raw") != ""))
    return rows.select("repo_id", "path", "ext", (F.col("pos") + 1).alias("line"), "raw")


def annotated_lines(files: DataFrame, comments: bool = True, docs: bool = True,
                    carry: dict | None = None, whole=None, explode: bool = True) -> DataFrame:
    """Lines with ``stripped`` text, ``masked`` (C4) and ``undocumented`` marks
    ('F', 'K' or other; D9/D10).  ``carry`` are columns worked out once per file.

    ``whole`` may add columns to the rows of whole files, from the arrays ``lines``,
    ``inside`` ('1' for masked lines; empty if none is) and ``doc``.  Without ``explode`` the rows stay files."""
    return annotated(split_lines(files), comments, docs, carry, whole=whole, explode=explode)


def annotated(arrays: DataFrame, comments: bool, docs: bool, carry: dict | None, placed: bool = False, whole=None,
              explode: bool = True) -> DataFrame:
    """The same from rows that hold arrays of lines: whole files or, ``placed``, parts of files with the
    comment ``state`` before them, the number of their ``first_line``, the ``file_lines`` of the whole
    file and the documentation letters that follow (``after_head``, ``after_mark``)."""
    carry = dict(carry or {})
    ext, lines = F.col("ext"), F.col("lines")
    carry["mark"] = T.comment_mark(ext)
    open_ = F.col("state") != "0" if placed else F.lit(False)
    quotes, blocks = (T.has_extension(ext, e) for e in (R.TRIPLE_QUOTE_EXTENSIONS, R.BLOCK_COMMENT_EXTENSIONS))

    def entered(letters: Column, first: str, second: str) -> Column:
        """The letters after that of a line which opens the block that a part begins in."""
        opener = F.when(F.col("state") == "1", first).when(F.col("state") == "2", second).otherwise("") if placed else None
        return letters if opener is None else F.concat(opener, letters)

    names = F.when(F.col("has_names") & (ext == ".py"), documentation_letters(lines))
    if placed:  # of what follows only so much that the lines here can see
        names = F.concat(names, F.col("after_head"), F.when(F.length("after_head") == 3, F.col("after_mark")).otherwise(""))
    arrays = arrays.withColumns({
        **carry,
        "letters": F.when((F.col("has_quotes") | open_) & quotes, entered(quote_letters(lines), "d", "s"))
        .when((F.col("has_block") | open_) & blocks, entered(block_letters(lines), "o", "o"))
        if comments else F.lit(None).cast("string"),
        "doc_letters": names if docs else F.lit(None).cast("string"),
    })
    none = F.array().cast("array<string>")
    # lines as a file iterator counts them: no empty remainder after a final break.
    # Counted before the explode, so that no line row carries its file's array along.
    counted = F.size("lines") - F.when(last_line_is_empty(F.col("lines")), 1).otherwise(0)
    inside, doc = _inside_flags(F.col("letters")), _documentation_flags(F.col("doc_letters"))
    first = F.lit(1)
    if placed:
        counted, first = F.col("file_lines"), F.col("first_line")
        inside = F.slice(inside, F.when(open_, 2).otherwise(1), F.size("lines"))
        doc = F.slice(doc, 1, F.size("lines"))
    flagged = arrays.select(
        "repo_id", "path", "ext", "lines", *carry, counted.alias("n_lines"), first.alias("first_line"),
        # most files have no block at all: they skip the run marking
        F.when(F.col("letters").rlike("[ods]"), inside).otherwise(none).alias("inside"),
        F.when(F.col("doc_letters").rlike("[fgkl]"), doc).otherwise(none).alias("doc"),
    )
    if whole is not None:
        flagged = whole(flagged)
    if not explode:
        return flagged
    return flagged.select(
        "repo_id", "path", "ext", *carry, "n_lines", "first_line",
        # not posexplode: Spark would test the array's size below, and work it out a second time for that
        F.posexplode_outer(F.arrays_zip("lines", "inside", "doc")).alias("pos", "cell"),
    ).where("pos IS NOT NULL").select(
        "repo_id", "path", "ext", *carry, "n_lines",
        (F.col("pos") + F.col("first_line")).cast("int").alias("line"),
        F.col("cell.lines").alias("raw"),
        T.strip(F.col("cell.lines")).alias("stripped"),
        F.coalesce(F.col("cell.inside") == "1", F.lit(False)).alias("masked"),
        F.col("cell.doc").alias("undocumented"),
    )
