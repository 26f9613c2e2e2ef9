"""Skip rules and first-match rule evaluation on annotated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.operators.chunks import annotated_chunks, placed_chunks, split_chunks
from siftlake.operators.dedup import dedup_hits
from siftlake.operators.lines import annotated_lines
from siftlake.operators.rule_index import candidate_match, candidates, words

# Line starts that the analysers skip.
COMMENT_STARTS = ("#", "//", "/*")
SECURITY_STARTS = COMMENT_STARTS + ("*", '"""', "'''")
IMPORT_STARTS = ("import ", "from ")


def kept_sql(skip: str, row: str = "") -> str:
    """SQL text of a skip rule on the texts of a line, which are columns or, in a lambda, fields of
    ``row``."""
    stripped, clean = f"{row}stripped", f"{row}clean"
    drop = [f"{stripped} = ''"]
    if skip == "security":  # C1, with a second look at the comment-free text
        drop += [f"{clean} = ''", T.starts_with_any(stripped, SECURITY_STARTS + IMPORT_STARTS),
                 T.starts_with_any(clean, COMMENT_STARTS + IMPORT_STARTS)]
    elif skip == "quality":  # C2
        drop += [T.starts_with_any(stripped, COMMENT_STARTS + IMPORT_STARTS + ("__import__",)),
                 f"contains({stripped}, 'import ')", f"endswith({stripped}, ' import')",
                 f"contains(left({stripped}, 10), 'from ')"]
    elif skip == "simple":  # C3
        drop += [T.starts_with_any(stripped, COMMENT_STARTS)]
    else:
        raise ValueError(f"unknown skip rule: {skip}")
    return f"NOT ({' OR '.join(drop)})"


def kept_by_security() -> Column:
    return F.expr(kept_sql("security"))


def kept_by_quality() -> Column:
    return F.expr(kept_sql("quality"))


def kept_simple() -> Column:
    return F.expr(kept_sql("simple"))


def pruned(path: Column, names) -> Column:
    """A2: is the file below a hidden directory or one of ``names``?"""
    dirs = F.split(path, "/")
    return F.exists(F.slice(dirs, 1, F.size(dirs) - 1),
                    lambda d: d.startswith(".") | d.isin(*names))


def reads(group: R.RuleGroup) -> Column:
    """Which files a group looks at; evaluated once per file."""
    keep = T.has_extension(F.col("path"), group.extensions)
    return keep & ~pruned(F.col("path"), R.VENDORED_DIRS) if group.prune else keep


def prepared_lines(lines: DataFrame) -> DataFrame:
    """Add the comment-free text, the folded text and the skip rules' verdicts."""
    return lines.withColumns({
        "clean": T.strip_comments(F.col("stripped"), F.col("mark")),
        "low": T.folded(F.col("raw")),
    }).withColumns({
        "kept_security": kept_by_security(),
        "kept_quality": kept_by_quality(),
        "kept_simple": kept_simple(),
    })


def _texts(values) -> str:
    return "array(" + ", ".join(T.sql_text(v or "") for v in values) + ")"


# Texts of the findings that no rule table holds.
FILENAME_ISSUE = "Dangerous filename with space/accent - will break on Linux/CI/imports"
LONG_FILE_LINES = 500


DOCUMENTATION = ("function", "class", "marker")


# --- what is found on the row of a file -------------------------------------------------------

WIDE = 200  # a group of more rules is matched through its index of literals


STEP = 1000  # the rules of the k-th group have the numbers from k * STEP on


def _needles(groups) -> dict[str, tuple[list[int], list[int]]]:
    """For each needed text the numbers of its rules, and of those that need no mark beside it."""
    out: dict[str, tuple[list[int], list[int]]] = {}
    for k, group in enumerate(groups):
        for i, rule in enumerate(group.rules):
            if rule.live:
                _, texts, marked = T.searched(rule.pattern, R.BUILT_IN)
                for text in texts:
                    every, plain = out.setdefault(text, ([], []))
                    every.append(k * STEP + i)
                    plain += [] if marked else [k * STEP + i]
    return out


def _numbers(values) -> str:
    return f"CAST(array({', '.join(map(str, values))}) AS array<int>)"


def _present(groups) -> str:
    """SQL text: the needed texts that a file has, with their rules.  Rules that need a mark are looked for in
    the lines that have one."""
    cells = []
    for text, (every, plain) in _needles(groups).items():
        read = " OR ".join(f"reads_{groups[k].name}" for k in sorted({n // STEP for n in every}))
        cells.append(f"CASE WHEN ({read}) AND contains({'whole_low' if plain else 'marked_low'}, {T.sql_text(text)}) THEN named_struct("
                     f"'literal', {T.sql_text(text)}, 'rules', {_numbers(every)}, 'plain', {_numbers(plain)}) END")
    return f"filter(array({', '.join(cells)}), n -> n IS NOT NULL)"


def _halved(number: str, leaves: list[tuple[int, str]]) -> str:
    """SQL text: the leaf of the last bound that is not above ``number``."""
    if len(leaves) == 1:
        return leaves[0][1]
    half = len(leaves) // 2
    return f"IF({number} < {leaves[half][0]}, {_halved(number, leaves[:half])}, {_halved(number, leaves[half:])})"


def _kept(group: R.RuleGroup) -> str:
    """SQL text: does the group look at the line ``x``?"""
    tests = [f"reads_{group.name}", f"x.kept_{group.skip}"]
    if group.mask:
        tests.append("NOT x.inside")
    if group.text == "clean":
        tests.append("x.clean <> ''")
    return " AND ".join(tests)


def _matched(groups) -> str:
    """SQL text: per element of ``texts`` the numbers of the rules that match, in their order."""
    leaves = []
    for k, g in enumerate(groups):
        own = [(k * STEP + i, f"rlike(x.{g.text}, {T.sql_text(T.searched(r.pattern, R.BUILT_IN)[0])})") for i, r in enumerate(g.rules) if r.live]
        leaves += [(k * STEP, f"{_kept(g)} AND {_halved('r', own)}")] if own else []
    return f"transform(texts, x -> filter(x.rules, r -> {_halved('r', leaves)}))"


def _first_of_group(k: int, group: R.RuleGroup) -> str:
    """SQL text: per element of ``texts`` the index of the group's first rule that matches, or null."""
    return (f"CASE WHEN reads_{group.name} THEN transform(matched, m -> get(filter(m, r -> r >= {k * STEP} AND r < {(k + 1) * STEP}), 0)"
            f" - {k * STEP}) END")


def _first_of_many(group: R.RuleGroup) -> str:
    """SQL text: the same for a group of very many rules, through its candidates in the file."""
    # the column is named twice: one that is named once would be worked out again for every line
    return (f"CASE WHEN size(candidates_{group.name}) > 0 THEN transform(texts, x -> CASE WHEN {_kept(group)} THEN "
            f"{candidate_match(f'candidates_{group.name}', f'x.{group.text}', 'x.low')} END) END")


def _not_seen(group: R.RuleGroup, seen: R.RuleGroup) -> str:
    """SQL text, E3 on the line itself: the hits of ``group`` that do not repeat the one of ``seen``."""
    return (f"transform(at_{group.name}, (h, i) -> CASE WHEN NOT coalesce(get({_texts(r.message for r in group.rules)}, h) = "
            f"get({_texts(r.message for r in seen.rules)}, get(at_{seen.name}, i)), false) THEN h END)")


def _first_of_each(column: str) -> str:
    """SQL text: of an array sorted by (issue, line) the first of each issue."""
    return f"filter({column}, (f, i) -> i = 0 OR f.issue <> get({column}, i - 1).issue)"


def _as_hits(column: str, rank: int, kind: str, dedup: str) -> str:
    return (f"transform({column}, f -> named_struct('line', f.line, 'rank', {rank}, 'rule', f.rule, 'severity', f.severity, "
            f"'issue', f.issue, 'type', '{kind}', 'dedup', '{dedup}', 'code_snippet', f.code_snippet))")


# Name of the function or class on a line.
_NAME = r"(?U)^(?:def|class)\s+(\w+)"


def _undocumented(lines: Column, flags: Column, kinds, first_line: Column) -> Column:
    """struct(issue, line, rule, severity, code_snippet) for each marked line."""
    forms = {"F": ("Missing docstring for function ", "LOW", "def ", "(...)"),
             "K": ("Missing docstring for class ", "MEDIUM", "class ", ":")}
    forms = {mark: form for mark, form in forms.items() if {"F": "function", "K": "class"}[mark] in kinds}

    def found(flag: Column, i: Column) -> Column:
        name = F.regexp_extract(T.strip(F.get(lines, i)), _NAME, 1)
        out = F.lit(None)
        for mark, (issue, severity, head, tail) in forms.items():
            out = F.when(flag == mark, F.struct(
                F.concat(F.lit(issue), name).alias("issue"), (first_line + i).cast("int").alias("line"), F.lit(0).alias("rule"),
                F.lit(severity).alias("severity"), F.concat(F.lit(head), name, F.lit(tail)).alias("code_snippet"))).otherwise(out)
        return out

    return F.filter(F.transform(flags, found), lambda f: f.isNotNull())


_HIT_ARRAY = ("array<struct<line:int,rank:int,rule:int,severity:string,issue:string,type:string,dedup:string,code_snippet:string>>")


def _texts_of_files(arrays: DataFrame, groups, wide) -> DataFrame:
    """Add ``texts``: the forms of the lines that may match a rule, and the numbers of these ``rules``.  Most lines of
    prose have none of the needed texts, and a text that is nowhere in the file is looked for in no line.  For ``wide``
    groups, whose ``candidates_…`` are added, all lines stay."""
    whole = T.folded(F.array_join("lines", "\n"))
    arrays = arrays.withColumn("whole_low", F.when(F.expr(" OR ".join(f"reads_{g.name}" for g in (*groups, *wide))), whole))
    arrays = arrays.withColumn("lows", F.split("whole_low", "\n", -1))
    rules = "CAST(array() AS array<int>)"
    if _needles(groups):
        arrays = arrays.withColumn("marks", F.transform("lows", lambda l: l.rlike(T.HAS_MARK)))
        arrays = arrays.withColumn("marked_low", F.array_join(F.filter("lows", lambda l, i: F.get("marks", i)), "\n"))
        arrays = arrays.withColumn("needles", F.expr(_present(groups)))
        arrays = arrays.withColumn("plain_needles", F.filter("needles", lambda n: F.size(n.plain) > 0))
        # the needles are named outside as well, see _first_of_many
        rules = ("CASE WHEN size(needles) + size(plain_needles) > 0 THEN IF(get(marks, i), flatten(filter(needles, n -> contains(l, n.literal)).rules), "
                 "flatten(filter(plain_needles, n -> contains(l, n.literal)).plain)) END")
    keep = "true" if wide else "size(s.rules) > 0"
    seen = F.expr(f"filter(transform(lows, (l, i) -> named_struct('pos', i, 'rules', {rules})), s -> {keep})")
    fields = {"pos": lambda x: x.pos, "raw": lambda x: F.get("lines", x.pos), "stripped": lambda x: T.strip(F.get("lines", x.pos)),
              "rules": lambda x: F.array_sort(x.rules)}
    if wide:
        fields["low"] = lambda x: F.get("lows", x.pos)
    if any(g.mask for g in (*groups, *wide)):
        fields["inside"] = lambda x: F.coalesce(F.get("inside", x.pos) == "1", F.lit(False))
    arrays = arrays.withColumn("texts", F.transform(seen, lambda x: F.struct(*[make(x).alias(n) for n, make in fields.items()])))
    if any(g.text == "clean" or g.skip == "security" for g in (*groups, *wide)):
        mark, names = F.col("mark"), list(fields)
        arrays = arrays.withColumn("texts", F.transform("texts", lambda x: F.struct(
            *[x[n].alias(n) for n in names], T.strip_comments(x.stripped, mark).alias("clean"))))
        fields["clean"] = None
    cells = [f"'{n}', x.{n}" for n in fields] + [f"'kept_{skip}', {kept_sql(skip, 'x.')}" for skip in {g.skip: 1 for g in (*groups, *wide)}]
    arrays = arrays.withColumn("texts", F.expr(f"transform(texts, x -> named_struct({', '.join(cells)}))")).drop(
        "whole_low", "lows", "marks", "marked_low", "needles", "plain_needles")
    if wide:  # columns of their own, named twice: within the look-ups they would be worked out again for every gate and rule
        arrays = arrays.withColumn("whole_low", F.array_join(F.col("texts.low"), "\n")).withColumn("runs", words(F.col("whole_low")))
        arrays = arrays.withColumns({f"candidates_{g.name}": F.when(
            F.col(f"reads_{g.name}"), candidates(g, F.col("whole_low"), F.col("runs"))) for g in wide})
    return arrays


def _once_per_file(first: str, rank: int, kind: str, issue: str, severity: str, snippet: str) -> Column:
    """A finding on the first line of a file, as an array."""
    return F.expr(f"CASE WHEN first_line = 1 AND get(lines, 0) IS NOT NULL AND {first} THEN array(named_struct('line', 1, 'rank', {rank}, "
                  f"'rule', -1, 'severity', '{severity}', 'issue', {issue}, 'type', '{kind}', 'dedup', '{R.ONCE_PER_LINE}', "
                  f"'code_snippet', {snippet})) ELSE hits END")


def filename_hits() -> Column:
    """Once per file."""
    return _once_per_file("bad_name", R.SECURITY.rank, "security", T.sql_text(FILENAME_ISSUE), "HIGH", "CAST(NULL AS STRING)")


def long_file_hits() -> Column:
    """Once per file."""
    return _once_per_file(
        f"may_be_long AND n_lines > {LONG_FILE_LINES}", R.MAINTAINABILITY.rank, "maintainability",
        "concat('File too long (', n_lines, ' lines) - consider splitting')", "MEDIUM", "concat('Total lines: ', n_lines)")


def marker_hits() -> Column:
    """TODO/FIXME marks in visible Python files.  ``upper_text`` is the file's text in upper case."""
    def cell(mark, order, issue, severity):
        return (f"CASE WHEN contains(u, '{mark}') THEN named_struct('line', CAST(first_line + i AS INT), 'rank', {R.RANKS['documentation']}, "
                f"'rule', {order}, 'severity', '{severity}', 'issue', '{issue}', 'type', 'documentation', 'dedup', '{R.ONCE_PER_LINE}', "
                f"'code_snippet', left({{snippet}}, 80)) END")

    snippet = f"btrim(get(lines, i), {T.sql_text(T.WHITESPACE)})"
    cells = ", ".join(c.format(snippet=snippet) for c in (
        cell("TODO", 1, "TODO comment found - address before release", "LOW"),
        cell("FIXME", 2, "FIXME comment found - fix before release", "MEDIUM")))
    return F.expr("CASE WHEN contains(upper_text, 'TODO') OR contains(upper_text, 'FIXME') THEN filter(flatten(transform("
                  f"split(upper_text, '\n', -1), (u, i) -> array({cells}))), f -> f IS NOT NULL) ELSE hits END")


def hits_of_files(arrays: DataFrame, groups, documentation=(), filenames=False, long_files=False) -> DataFrame:
    """Add ``hits``: what the groups, the file itself (D7, D8) and D9 to D11 give in the arrays of a row.  The first line
    per message (E2) is chosen here, so nothing has to be brought together later."""
    arrays = arrays.withColumn("hits", F.array().cast(_HIT_ARRAY))
    parts = []
    few, wide = [g for g in groups if len(g.rules) <= WIDE], [g for g in groups if len(g.rules) > WIDE]
    if groups:
        arrays = _texts_of_files(arrays, few, wide)
    if _needles(few):
        arrays = arrays.withColumn("matched", F.expr(_matched(few)))
        arrays = arrays.withColumns({f"at_{g.name}": F.expr(_first_of_group(k, g)) for k, g in enumerate(few)})
    else:
        arrays = arrays.withColumns({f"at_{g.name}": F.lit(None).cast("array<int>") for g in few})
    arrays = arrays.withColumns({f"at_{g.name}": F.expr(_first_of_many(g)) for g in wide})
    named = {g.name: g for g in groups}
    if {"security", "advanced"} <= set(named):  # E3 looks at both on the line
        first, again = named["security"], named["advanced"]
        if {r.message for r in first.rules if r.live} & {r.message for r in again.rules if r.live}:
            arrays = arrays.withColumn("at_advanced", F.expr(_not_seen(again, first)))
    arrays = arrays.withColumns({f"found_{g.name}": F.expr(
        f"filter(transform(at_{g.name}, (h, i) -> CASE WHEN h IS NOT NULL THEN named_struct('issue', "
        f"get({_texts(r.message for r in g.rules)}, h), 'line', CAST(first_line + get(texts, i).pos AS INT), 'rule', h, 'severity', "
        f"get({_texts(r.severity for r in g.rules)}, h), 'code_snippet', get(texts, i).stripped) END), f -> f IS NOT NULL)")
        for g in groups})
    for g in groups:
        column = f"found_{g.name}"
        if g.dedup == R.FIRST_PER_MESSAGE:
            arrays = arrays.withColumn(column, F.array_sort(column)).withColumn(column, F.expr(_first_of_each(column)))
        parts.append(F.expr(f"coalesce({_as_hits(column, g.rank, g.issue_type, g.dedup)}, hits)"))
    undocumented = [k for k in documentation if k != "marker"]
    if undocumented:
        found = F.when(F.col("documented"), _undocumented(F.col("lines"), F.col("doc"), undocumented, F.col("first_line")))
        arrays = (arrays.withColumn("found_doc", F.array_sort(found)).withColumn("found_doc", F.expr(_first_of_each("found_doc"))))
        parts.append(F.expr(f"coalesce({_as_hits('found_doc', R.RANKS['documentation'], 'documentation', R.FIRST_PER_MESSAGE)}, hits)"))
    if "marker" in documentation:
        arrays = arrays.withColumn("upper_text", F.when(F.col("documented"), F.upper(F.array_join("lines", "\n"))))
        parts.append(marker_hits())
    parts += [filename_hits()] if filenames else []
    parts += [long_file_hits()] if long_files else []
    return arrays.withColumn("hits", F.concat(F.col("hits"), *parts))


HIT_COLUMNS = ("line", "rank", "rule", "severity", "issue", "type", "dedup", "code_snippet")


def line_hits(files: DataFrame, groups=(), filenames=False, long_files=False,
              documentation=(), giant_bytes: int | None = None) -> DataFrame:
    """Everything asked for in one narrow pass over the files, on the row of the file: the rules that may match
    in it, the lines that may match one of them, the first rule of each group on such a line, and with it the first line per
    message.  Then each hit becomes a row.

    A file is one row and so one task's work.  With ``giant_bytes`` larger files are cut into
    chunks that are worked out by themselves; that reads the table a second time.  ``files`` may
    also be chunks with their places (:func:`siftlake.operators.chunks.placed_chunks`).  Chunks give
    the first line per message of the chunk; these hits are then brought together per file."""
    if "first_line" in files.columns:
        return _over_chunks(_hits(files, annotated_chunks, groups, filenames, long_files, documentation))
    if giant_bytes is None:
        return _hits(files, annotated_lines, groups, filenames, long_files, documentation)
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    giant = placed_chunks(split_chunks(files.where(size > giant_bytes)))
    small = _hits(files.where(size <= giant_bytes), annotated_lines, groups, filenames, long_files, documentation)
    return small.unionByName(_over_chunks(_hits(giant, annotated_chunks, groups, filenames, long_files, documentation)))


def _over_chunks(hits: DataFrame) -> DataFrame:
    return dedup_hits(hits, "dedup")


def _hits(rows: DataFrame, annotate, groups, filenames, long_files, documentation) -> DataFrame:
    path = F.col("path")
    visible = ~pruned(path, R.VENDORED_DIRS)
    carry = {f"reads_{g.name}": reads(g) for g in groups}
    if filenames:
        carry["bad_name"] = (T.has_extension(path, R.SECURITY_EXTENSIONS)
                             & T.file_name(path).rlike(r"[^\x00-\x7F]| "))
    if long_files:
        carry["may_be_long"] = T.has_extension(path, R.STYLE_EXTENSIONS) & visible
    if documentation:
        carry["documented"] = T.has_extension(path, R.DOCUMENTATION_EXTENSIONS) & visible
    found = annotate(
        rows, comments=any(g.mask or g.text == "clean" for g in groups), docs=any(k != "marker" for k in documentation), carry=carry,
        whole=lambda arrays: hits_of_files(arrays, groups, documentation, filenames, long_files), explode=False)
    # outer, and the test behind it: Spark would test the array's size below, and work it out a second time for that
    return found.select("repo_id", "path", F.explode_outer("hits").alias("hit")).where(F.col("hit").isNotNull()).select(
        "repo_id", "path", *[f"hit.{c}" for c in HIT_COLUMNS])


def filename_findings(files: DataFrame) -> DataFrame:
    """D7 by itself: reads paths only."""
    path = F.col("path")
    bad = T.has_extension(path, R.SECURITY_EXTENSIONS) & T.file_name(path).rlike(r"[^\x00-\x7F]| ")
    return files.where(bad).select(
        "repo_id", "path", F.lit(1).alias("line"), F.lit(R.SECURITY.rank).alias("rank"), F.lit(-1).alias("rule"),
        F.lit("HIGH").alias("severity"), F.lit(FILENAME_ISSUE).alias("issue"), F.lit("security").alias("type"),
        F.lit(None).cast("string").alias("code_snippet"))


def long_file_findings(files: DataFrame) -> DataFrame:
    """D8 by itself: lines are counted, not made."""
    path, text = F.col("path"), T.unify_newlines(F.col("content"))
    seen = files.where(T.has_extension(path, R.STYLE_EXTENSIONS) & ~pruned(path, R.VENDORED_DIRS))
    last = F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    count = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + last).cast("string")
    return seen.select("repo_id", "path", count.alias("n")).where(F.col("n").cast("long") > LONG_FILE_LINES).select(
        "repo_id", "path", F.lit(1).alias("line"), F.lit(R.MAINTAINABILITY.rank).alias("rank"),
        F.lit(-1).alias("rule"), F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("File too long ("), "n", F.lit(" lines) - consider splitting")).alias("issue"),
        F.lit("maintainability").alias("type"), F.concat(F.lit("Total lines: "), "n").alias("code_snippet"))
