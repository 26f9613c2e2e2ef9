"""Shared parts of the comparison SQL (DuckDB dialect).

Written apart from the Spark side: comment state by windows and a fold, first
matches by window, docstrings by running function numbers.  Only the fixed values
(rule patterns, word lists, the line bank) are the same data."""

from __future__ import annotations

from siftlake import rules as R
from siftlake.functions.text import WHITESPACE
from siftlake.operators.matching import FILENAME_ISSUE
from siftlake.workload.bank import BANK, DIRS, EXTENSIONS, STEMS


def lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(lit(v) for v in values)


def pick(values, index: str) -> str:
    return f"([{items(values)}])[1 + {index} % {len(values)}]"


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(WHITESPACE)})"


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def starts_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, {lit(w)})" for w in words) + ")"


def ends_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {lit(w)})" for w in words) + ")"


FILES = f"""
bank AS (SELECT [{items(BANK)}] AS b),
named AS (
  SELECT *, doc_id % 20 IN (3, 7) AS no_py, {pick(EXTENSIONS, 'doc_id')} AS ext0 FROM documents),
files AS MATERIALIZED (
  SELECT doc_id, source AS repo_id,
    CASE WHEN doc_id < 20 THEN 'main' || CASE WHEN no_py THEN '.js' ELSE '.py' END
         WHEN doc_id < 40 THEN 'app' || CASE WHEN no_py THEN '.js' ELSE '.py' END
         ELSE {pick(DIRS, 'doc_id')} || {pick(STEMS, 'doc_id')} || doc_id::VARCHAR
              || CASE WHEN no_py AND ext0 = '.py' THEN '.js' ELSE ext0 END END AS path,
    CASE WHEN doc_id % 5 = 0 THEN array_to_string(code, chr(13) || chr(10))
         ELSE array_to_string(code, chr(10)) END
      || chr(10) || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END AS content
  FROM (SELECT *, list_transform(
      range(0, CASE WHEN doc_id % 97 = 5 THEN 520 ELSE 16 + doc_id % 25 END),
      lambda k: b[1 + (doc_id * 31 + k * 17) % {len(BANK)}]) AS code FROM named, bank))
"""

EXT = r"regexp_extract(path, '(?:^|/)\.*[^/.][^/]*(\.[^./]*)$', 1)"
HIDDEN = "len(list_filter(string_split(path, '/')[:-2], lambda d: starts_with(d, '.') OR d IN ({}))) > 0"
VENDORED = HIDDEN.format(items(R.VENDORED_DIRS))
IGNORED = HIDDEN.format(items(R.IGNORED_DIRS))

SPLIT = FILES + f""",
split AS (
  SELECT *, {EXT} AS ext, {VENDORED} AS vendored,
    string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS arr FROM files),
lines0 AS MATERIALIZED (
  SELECT repo_id, path, ext, vendored, len(arr) AS n, unnest(range(1, len(arr) + 1))::INTEGER AS line,
    unnest(arr) AS raw FROM split)
"""

_DQ, _SQ = lit('"""'), lit("'''")
_PER_FILE = "PARTITION BY repo_id, path ORDER BY line ROWS UNBOUNDED PRECEDING"

LINES = SPLIT + f""",
coded AS (
  SELECT *, {strip('raw')} AS stripped,
    CASE WHEN ext NOT IN ({items(R.BLOCK_COMMENT_EXTENSIONS)}) THEN NULL
         WHEN contains(raw, '/*') AND contains(raw, '*/') THEN NULL
         WHEN contains(raw, '/*') THEN 1 WHEN contains(raw, '*/') THEN 0 END AS block_event,
    CASE WHEN ext NOT IN ({items(R.TRIPLE_QUOTE_EXTENSIONS)}) THEN NULL
         WHEN contains(raw, {_DQ}) THEN CASE WHEN len(string_split(raw, {_DQ})) > 2 THEN 'D' ELSE 'd' END
         WHEN contains(raw, {_SQ}) THEN CASE WHEN len(string_split(raw, {_SQ})) > 2 THEN 'S' ELSE 's' END
    END AS quote_event
  FROM lines0),
folds AS (
  SELECT repo_id, path, list_reduce(list_prepend('N', list(quote_event ORDER BY line)), lambda acc, e:
    acc || CASE right(acc, 1)
      WHEN 'N' THEN CASE e WHEN 'd' THEN 'D' WHEN 's' THEN 'S' ELSE 'N' END
      WHEN 'D' THEN CASE WHEN e IN ('d', 'D') THEN 'N' ELSE 'D' END
      ELSE CASE WHEN e IN ('s', 'S') THEN 'N' ELSE 'S' END END) AS states
  FROM coded WHERE quote_event IS NOT NULL GROUP BY repo_id, path),
lines AS MATERIALIZED (
  SELECT c.*, CASE
      WHEN c.ext IN ({items(R.BLOCK_COMMENT_EXTENSIONS)}) THEN
        coalesce(last_value(block_event IGNORE NULLS) OVER ({_PER_FILE.replace('repo_id, path', 'c.repo_id, c.path')}), 0) = 1
      WHEN states IS NULL THEN false
      ELSE substr(states, 1 + (count(quote_event) OVER ({_PER_FILE.replace('repo_id, path', 'c.repo_id, c.path')}))::INTEGER, 1) <> 'N'
    END AS masked,
    CASE WHEN c.ext IN ({items(R.HASH_COMMENT_EXTENSIONS)}) THEN {strip("string_split(flat, '#')[1]")}
         WHEN c.ext IN ({items(R.SLASH_COMMENT_EXTENSIONS)}) THEN {strip("string_split(flat, '//')[1]")}
         ELSE flat END AS clean
  FROM (SELECT *, {strip("replace(replace(stripped, chr(160), ' '), chr(9), ' ')")} AS flat FROM coded) c
  LEFT JOIN folds USING (repo_id, path))
"""


def _condition(group: R.RuleGroup, i: int) -> str:
    pattern = group.rules[i].pattern
    if "(?!.*" in pattern:  # RE2 has no lookahead: match behind the last stop text
        head, stop = pattern[:-1].split("(?!.*")
        return f"regexp_matches(regexp_replace({group.text}, '^.*{stop}', '', 'i'), {lit(head)}, 'i')"
    return f"regexp_matches({group.text}, {lit(pattern)}, 'i')"


_COMMENT = ("#", "//", "/*")
_IMPORT = ("import ", "from ")
KEEP = {
    "own": f"NOT masked AND stripped <> '' AND NOT {starts_any('stripped', _COMMENT)}",
    "security": f"NOT masked AND stripped <> '' AND clean <> '' AND NOT "
                f"{starts_any('stripped', _COMMENT + ('*', chr(34) * 3, chr(39) * 3) + _IMPORT)} "
                f"AND NOT {starts_any('clean', _COMMENT + _IMPORT)}",
    "advanced": f"NOT masked AND stripped <> '' AND clean <> '' AND NOT {starts_any('stripped', _COMMENT)}",
    "quality": f"stripped <> '' AND NOT {starts_any('stripped', _COMMENT + _IMPORT + ('__import__',))} "
               "AND NOT contains(stripped, 'import ') AND NOT ends_with(stripped, ' import') "
               "AND NOT contains(left(stripped, 10), 'from ')",
}
SIMPLE = f"stripped <> '' AND NOT {starts_any('stripped', _COMMENT)}"


def group_cte(group: R.RuleGroup) -> str:
    """Findings of a rule group as CTE ``<name>_rows``."""
    whens = "\n".join(f"WHEN {_condition(group, i)} THEN {i}"
                      for i, r in enumerate(group.rules) if r.live)
    table = ", ".join(f"({i}, {lit(r.message)}, {lit(r.severity)})"
                      for i, r in enumerate(group.rules) if r.live)
    keep = KEEP.get(group.name, SIMPLE) + (" AND NOT vendored" if group.prune else "")
    first = ("QUALIFY row_number() OVER (PARTITION BY repo_id, path, issue ORDER BY line) = 1"
             if group.dedup == R.FIRST_PER_MESSAGE else "")
    n = group.name
    return f"""
{n}_hits AS MATERIALIZED (
  SELECT repo_id, path, line, stripped, CASE {whens} END AS rule FROM lines
  WHERE {ends_any('path', group.extensions)} AND {keep}),
{n}_rows AS MATERIALIZED (
  SELECT repo_id, path, line, {group.rank} AS "rank", h.rule, severity, issue,
    '{group.issue_type}' AS type, stripped AS code_snippet
  FROM {n}_hits h JOIN (VALUES {table}) AS t(rule, issue, severity) ON t.rule = h.rule {first})"""


FINDING = "repo_id, path, line, severity, issue, type, code_snippet"

FILENAME = f"""
filename_rows AS (
  SELECT repo_id, path, 1 AS line, 10 AS "rank", -1 AS rule, 'HIGH' AS severity,
    {lit(FILENAME_ISSUE)} AS issue, 'security' AS type, NULL::VARCHAR AS code_snippet
  FROM files WHERE {ends_any('path', R.SECURITY_EXTENSIONS)}
    AND (contains(string_split(path, '/')[-1], ' ') OR strlen(string_split(path, '/')[-1]) <> length(string_split(path, '/')[-1])))"""

LONG_FILE = f"""
long_rows AS (
  SELECT repo_id, path, 1 AS line, 60 AS "rank", -1 AS rule, 'MEDIUM' AS severity,
    'File too long (' || k || ' lines) - consider splitting' AS issue, 'maintainability' AS type,
    'Total lines: ' || k AS code_snippet
  FROM (SELECT repo_id, path, count(*) FILTER (line < n OR raw <> '') AS k FROM lines0
        WHERE NOT vendored AND {ends_any('path', R.STYLE_EXTENSIONS)} GROUP BY repo_id, path)
  WHERE k > 500)"""

_QUOTED = f"(contains(raw, {_DQ}) OR contains(raw, {_SQ}))"
DOCUMENTATION = f"""
doc_lines AS MATERIALIZED (
  SELECT *, is_def OR NOT is_class AND quoted AS marks,
    sum(is_def::INTEGER) OVER ({_PER_FILE}) AS fn, lead(quoted, 1, false) OVER f OR lead(quoted, 2, false) OVER f
      OR lead(quoted, 3, false) OVER f AS class_doc
  FROM (SELECT repo_id, path, line, raw, {strip('raw')} AS stripped, {_QUOTED} AS quoted,
          regexp_matches({strip('raw')}, '^def\\s+\\w+\\s*\\(') AS is_def,
          regexp_matches({strip('raw')}, '^class\\s+\\w+') AS is_class
        FROM lines0 WHERE ends_with(path, '.py') AND NOT vendored)
  WINDOW f AS (PARTITION BY repo_id, path ORDER BY line)),
functions AS (
  SELECT repo_id, path, fn, min(line) AS line, arg_min(regexp_extract(stripped, '^def\\s+(\\w+)', 1), line) AS name,
    bool_or(quoted AND NOT is_def AND NOT is_class) AS has_doc,
    max(fn) OVER (PARTITION BY repo_id, path) AS last_fn
  FROM doc_lines WHERE fn > 0 GROUP BY repo_id, path, fn),
doc_function_rows AS (
  SELECT repo_id, path, line, 80 AS "rank", 0 AS rule, 'LOW' AS severity,
    'Missing docstring for function ' || name AS issue, 'documentation' AS type,
    'def ' || name || '(...)' AS code_snippet
  FROM functions WHERE fn < last_fn AND NOT has_doc
  QUALIFY row_number() OVER (PARTITION BY repo_id, path, name ORDER BY line) = 1),
doc_class_rows AS (
  SELECT repo_id, path, line, 80 AS "rank", 0 AS rule, 'MEDIUM' AS severity,
    'Missing docstring for class ' || name AS issue, 'documentation' AS type,
    'class ' || name || ':' AS code_snippet
  FROM (SELECT *, regexp_extract(stripped, '^class\\s+(\\w+)', 1) AS name FROM doc_lines
        WHERE is_class AND NOT class_doc)
  QUALIFY row_number() OVER (PARTITION BY repo_id, path, name ORDER BY line) = 1),
doc_marker_rows AS (
  SELECT repo_id, path, line, 80 AS "rank", m.rule, m.severity, m.issue, 'documentation' AS type,
    left(stripped, 80) AS code_snippet
  FROM doc_lines JOIN (VALUES ('TODO', 1, 'LOW', 'TODO comment found - address before release'),
    ('FIXME', 2, 'MEDIUM', 'FIXME comment found - fix before release')) AS m(word, rule, severity, issue)
    ON contains(upper(raw), m.word))"""

_PARTS = [f"{g.name}_rows" for g in R.ALL_GROUPS] + [
    "filename_rows", "long_rows", "doc_function_rows", "doc_class_rows", "doc_marker_rows"]

OWN = LINES + "".join("," + group_cte(g) for g in R.ALL_GROUPS) + "," + FILENAME + "," \
    + LONG_FILE + "," + DOCUMENTATION + """,
own AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT * FROM {p}" for p in _PARTS) + ")"

GATES = f"""
gates AS (
  SELECT repo_id, bool_or(ends_with(path, '.py')) AS has_python,
    bool_or({ends_any('path', ('.py',) + R.OTHER_LANGUAGE_EXTENSIONS)}) AS has_code
  FROM files GROUP BY repo_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
