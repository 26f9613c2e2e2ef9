"""Comparison SQL of the registered queries (DuckDB)."""

from __future__ import annotations

from dataclasses import replace

from siftlake import rules as R
from siftlake.functions import classify as C
from siftlake.operators import metrics as M, structure as S
from siftlake.plans import report as P
from siftlake.sources import corpus, test_reports as TR, tool_reports as TO
from siftlake.workload import oracle_base as B, tables as T
from siftlake.workload.queries import OWN as OWN_GROUP
from siftlake.workload.oracle_base import FINDING, contains_any, items, lit, pick, strip, with_

SQL = {}
for _g in R.ALL_GROUPS:
    SQL[f"rules_{_g.name}"] = with_(B.LINES, B.group_cte(_g)) + f"SELECT {FINDING} FROM {_g.name}_rows"
SQL["rule_filename"] = with_(B.FILES, B.FILENAME) + f"SELECT {FINDING} FROM filename_rows"
# the same rules without back references and codes, which RE2 lacks
_TWIN = replace(OWN_GROUP, rules=tuple(replace(r, pattern=p) for r, p in zip(OWN_GROUP.rules, (
    """'.*'|".*\"""", "zq|pass.*word", "TODO", "retu.*n", r"\w.*="))))
SQL["rules_own"] = with_(B.LINES, B.group_cte(_TWIN)) + f"SELECT {FINDING} FROM own_rows"
SQL["rules_table"] = with_(B.LINES, *[B.group_cte(g) for g in (*R.ALL_GROUPS, _TWIN)]) + " UNION ALL ".join(
    f'SELECT "rank", {FINDING} FROM {g.name}_rows' + (
        " ANTI JOIN (SELECT repo_id, path, line, issue FROM security_rows) USING (repo_id, path, line, issue)" if g is R.ADVANCED else "")
    for g in (*R.ALL_GROUPS, _TWIN))
SQL["rules_watch_words"] = with_(B.LINES, f"""
words AS MATERIALIZED (
  SELECT word, row_number() OVER (ORDER BY word) - 1 AS rule FROM (
    SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 6),
hits AS (
  SELECT repo_id, path, line, stripped, min(rule) AS rule FROM lines JOIN words ON contains(lower(stripped), word)
  WHERE {B.ends_any('path', ('.py', '.js', '.rb'))} AND {B.SIMPLE} GROUP BY ALL)""") + """
SELECT repo_id, path, line, ['LOW', 'MEDIUM', 'HIGH'][rule % 3 + 1] AS severity, 'Watched word ' || word AS issue, 'quality' AS type,
  stripped AS code_snippet
FROM hits JOIN words USING (rule) QUALIFY row_number() OVER (PARTITION BY repo_id, path, word ORDER BY line) = 1"""
SQL["scan_tree"] = """SELECT 'repo=' || source AS repo_id, 'name=' || doc_id AS folder,
  md5(coalesce(text, '') || chr(10)) AS md5, strlen(coalesce(text, ''))::BIGINT + 1 AS size_bytes FROM documents"""
SQL["tree_line_blocks"] = f"""
SELECT 'repo=' || source AS repo_id, 'name=' || doc_id AS folder, pos AS line, len(ls)::BIGINT AS lines, md5(ls[pos]) AS md5 FROM (
  SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM (
    SELECT source, doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents))"""
SQL["rule_long_file"] = with_(B.SPLIT, B.LONG_FILE) + f"SELECT {FINDING} FROM long_rows"
for _n, _r in (("missing_function", "function"), ("missing_class", "class"), ("markers", "marker")):
    SQL[f"doc_{_n}"] = with_(B.SPLIT, B.DOCUMENTATION) + f"SELECT {FINDING} FROM doc_{_r}_rows"
    if _r != "marker":
        SQL[f"doc_{_n}_chunked"] = SQL[f"doc_{_n}"]

# --- corpus, lines and scalar functions -------------------------------------

_SETS = {"security": R.SECURITY_EXTENSIONS, "quality": R.QUALITY_EXTENSIONS,
         "style": R.STYLE_EXTENSIONS, "documentation": R.DOCUMENTATION_EXTENSIONS,
         "code": R.CODE_EXTENSIONS, "other_language": R.OTHER_LANGUAGE_EXTENSIONS,
         "payload": R.PAYLOAD_EXTENSIONS, "config": R.CONFIG_EXTENSIONS}
NAME = "string_split(path, '/')[-1]"
VISIBLE = f"NOT {B.IGNORED} AND NOT starts_with({NAME}, '.')"
FOLDED = "regexp_replace(content, '\r\n?', chr(10), 'g')"

SQL["scan_corpus"] = with_(B.FILES) + "SELECT repo_id, path, length(content)::INTEGER AS chars, " + ", ".join(
    f"{B.ends_any('path', e)} AS in_{n}" for n, e in _SETS.items()) + " FROM files"
SQL["prune_dirs"] = with_(B.FILES) + f"SELECT repo_id, path, {B.IGNORED} AS ignored FROM files WHERE NOT {B.VENDORED}"
SQL["repository_files"] = with_(B.FILES) + f"SELECT repo_id, path FROM files WHERE {VISIBLE}"
SQL["decode_text"] = with_(B.FILES) + f"SELECT repo_id, path, {FOLDED} || 'A(B' AS text FROM files"
SQL["explode_lines"] = with_(B.SPLIT) + "SELECT repo_id, path, line, raw FROM lines0"
SQL["explode_lines_iterated"] = with_(B.SPLIT) + "SELECT repo_id, path, line, raw FROM lines0 WHERE line < n OR raw <> ''"
SQL["strip_line"] = with_(B.SPLIT) + f"SELECT repo_id, path, line, {strip('raw')} AS stripped FROM lines0"
SQL["strip_comments"] = with_(B.LINES) + "SELECT repo_id, path, line, clean FROM lines"
SQL["file_ext"] = with_(B.FILES) + f"""SELECT repo_id, path,
  CASE WHEN contains(ltrim({NAME}, '.'), '.') THEN '.' || string_split({NAME}, '.')[-1] ELSE '' END AS ext
  FROM files"""
SQL["safe_filename"] = with_(B.FILES) + \
    "SELECT repo_id, path, replace(replace(replace(path, ' ', '_'), 'á', 'a'), 'é', 'e') AS safe FROM files"
SQL["snippet_clip"] = with_(B.SPLIT) + f"""SELECT repo_id, path, line, left({strip('raw')}, 80) AS clip80,
  left({strip('raw')}, 100) AS clip100 FROM lines0"""
SQL["clean_report_path"] = with_(B.FILES) + f"""SELECT repo_id, path,
  ltrim({strip("' ./' || path || chr(9)")}, './') AS from_dot, ltrim({strip("'../' || path")}, './') AS from_up,
  ltrim({strip('path')}, './') AS from_path FROM files"""

REPORTS = B.FILES + """,
reports0 AS (
  SELECT doc_id AS d, doc_id AS report_id, source AS repo_id, lang, f.path,
    'https://github.com/' || lang || '/' || source AS web
  FROM documents JOIN (SELECT doc_id, path FROM files) f USING (doc_id)),
reports AS MATERIALIZED (
  SELECT *, ([web || '.git', web || '/', '  git@gitlab.com:' || upper(lang[1]) || lang[2:] || '/' || upper(repo_id) || '.git ',
    repo_id, 'git@host:' || repo_id, web, 'https://x.y/',
    'https://host.example/group/sub/' || repo_id || '-api.git/'])[1 + d % 8] AS repo_url,
    d % 50 = 7 AS is_array, d % 50 = 8 AS is_other
  FROM reports0),
named_urls AS (
  SELECT *, regexp_extract(bare, '([^/]*)$', 1) AS tail,
    CASE WHEN contains(bare, '/') THEN string_split(bare, '/')[-1] ELSE string_split(bare, ':')[-1] END AS last_part
  FROM (SELECT *, regexp_replace(rtrim(trim(repo_url), '/'), '\\.git$', '') AS bare FROM reports)),
owned AS (
  SELECT *, lower(last_part) AS name,
    lower(regexp_extract(bare, '[:/]([^/]+)/([^/]+?)(?:\\.git)?$', 1)) AS owner,
    CASE WHEN regexp_matches(bare, '[:/]([^/]+)/([^/]+?)(?:\\.git)?$')
         THEN lower(regexp_extract(bare, '[:/]([^/]+)/([^/]+?)(?:\\.git)?$', 2)) ELSE lower(last_part) END AS repo
  FROM named_urls)
"""
SQL["repo_name"] = with_(REPORTS) + "SELECT report_id, repo_url, name FROM owned"
SQL["owner_repo"] = with_(REPORTS) + "SELECT report_id, repo_url, owner, repo FROM owned"
SQL["valid_repo_url"] = with_(REPORTS) + """SELECT report_id, repo_url, length(trim(repo_url)) >= 10 AS valid,
  NOT regexp_matches(repo_url, 'github\\.com|gitlab\\.com|bitbucket\\.org') AS unusual FROM reports"""

# --- line filters -----------------------------------------------------------

SQL["skip_lines_security"] = with_(B.LINES) + "SELECT repo_id, path, line, clean FROM lines WHERE " + \
    B.KEEP["security"].replace("NOT masked AND ", "")
SQL["skip_lines_quality"] = with_(B.LINES) + f"SELECT repo_id, path, line, stripped FROM lines WHERE {B.KEEP['quality']}"
SQL["skip_lines_simple"] = with_(B.LINES) + f"SELECT repo_id, path, line, stripped FROM lines WHERE {B.SIMPLE}"
SQL["mask_block_comments"] = with_(B.LINES) + "SELECT repo_id, path, line, raw FROM lines WHERE NOT masked"
SQL["mask_block_comments_chunked"] = SQL["mask_block_comments"]
SQL["drop_blank_files"] = with_(B.SPLIT) + f"""SELECT repo_id, path || '#' || line AS path FROM lines0
  WHERE {strip('raw')} <> ''"""
SQL["max_file_size"] = with_(B.FILES) + """SELECT repo_id, path, strlen(content) <= 20000 AS standard,
  strlen(content) <= 100000 AS deep FROM files"""
BUDGET = f"""
sizes AS (SELECT repo_id, path, content, length({FOLDED})::BIGINT AS chars FROM files
  WHERE {B.ends_any('path', R.PAYLOAD_EXTENSIONS)} AND strlen(content) <= 20000 AND {strip('content')} <> ''),
budget AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY repo_id ORDER BY path
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sizes
  QUALIFY before <= 100000)"""
SQL["size_budget"] = with_(B.FILES, BUDGET) + "SELECT repo_id, path, chars, before FROM budget"
SQL["prompt_text"] = with_(B.FILES, BUDGET) + f"""
SELECT repo_id, 'Repository: ' || repo_id || chr(10) || chr(10) || 'Code files to analyze:' || chr(10) ||
  string_agg(chr(10) || '=== ' || path || ' ===' || chr(10) || left({FOLDED}, 1000)
    || CASE WHEN length({FOLDED}) > 1000 THEN '...' ELSE '' END || chr(10), '' ORDER BY path) AS prompt
FROM budget GROUP BY repo_id"""

# --- findings of other tools ------------------------------------------------

TOOLS = f"""
bandit AS (SELECT * FROM (
  SELECT repo_id, doc_id AS report_id, (k - 1)::INTEGER AS rule, '/' || path AS path,
    (k * 3 + doc_id % 5)::INTEGER AS line, {pick(['LOW', 'MEDIUM', 'HIGH'], '(doc_id + k)')} AS severity,
    {pick(T.BANDIT_TEXTS, '(doc_id % 20)')} AS issue, 'security' AS type
  FROM (SELECT *, unnest(range(1, doc_id % 4 + 1)) AS k FROM files))
  WHERE NOT {contains_any('lower(issue)', TO.BANDIT_SKIP)}),
pylint AS (SELECT * FROM (
  SELECT repo_id, doc_id AS report_id, (k - 1)::INTEGER AS rule, '/' || path AS path,
    (k + doc_id % 7)::INTEGER AS line, {pick(T.PYLINT_TYPES, '(doc_id + k)')} AS severity,
    {pick(T.PYLINT_TEXTS, '(doc_id % 20)')} AS issue, 'quality' AS type
  FROM (SELECT *, unnest(range(1, doc_id % 3 + 2)) AS k FROM files))
  WHERE severity IN ({items(TO.PYLINT_KEEP)}) AND NOT {contains_any('lower(issue)', TO.PYLINT_SKIP)}),
semgrep AS (
  SELECT repo_id, d AS report_id, (k - 1)::INTEGER AS rule, path,
    CASE WHEN d % 5 <> 2 THEN k + d % 7 ELSE 1 END::INTEGER AS line,
    CASE upper({pick(T.SEMGREP_LEVELS, '(d + k)')}) WHEN 'ERROR' THEN 'HIGH' WHEN 'INFO' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
    NULL::VARCHAR AS issue,
    CASE {pick(T.SEMGREP_AREAS, '(d + k * 2)')} WHEN 'best-practice' THEN 'best_practice' WHEN 'correctness' THEN 'quality'
      WHEN 'performance' THEN 'performance' WHEN 'maintainability' THEN 'maintainability' ELSE 'security' END AS type,
    CASE WHEN d % 5 <> 3 THEN k ELSE 1 END::INTEGER AS "column",
    CASE WHEN d % 11 <> 4 THEN 'line "' || path || '"' ELSE '' END AS code_snippet,
    CASE WHEN d % 6 <> 1 THEN 'rule.' || d % 9 ELSE 'semgrep' END AS rule_id,
    CASE WHEN d % 7 <> 4 THEN 'finding ' || k ELSE {lit(TO.SEMGREP_MESSAGE)} END AS description, 'semgrep' AS tool
  FROM (SELECT *, doc_id AS d, unnest(range(1, doc_id % 3 + 2)) AS k FROM files)),
responses AS MATERIALIZED (
  SELECT *, CASE WHEN turn % 3 = 1 THEN prose WHEN turn % 3 = 2 THEN '{{"issues": [ ' || prose || ' }}' END AS report FROM (
    SELECT *, 'src' || conv_id % 20 AS repo_id, conv_id * 100 + turn AS report_id,
      array_to_string(list_transform(range(0, (conv_id + turn) % 30 + 2), lambda k:
        ([{items(T.PROSE)}])[1 + (conv_id * 7 + turn * 5 + k * 3) % {len(T.PROSE)}]), chr(10)) || chr(10) || text AS prose
    FROM conversations)),
prose_lines AS (
  SELECT repo_id, report_id, unnest(range(0, len(string_split(report, chr(10)))))::INTEGER AS rule,
    unnest(string_split(report, chr(10))) AS text FROM responses WHERE report IS NOT NULL),
prose AS (
  SELECT *, CASE {' '.join(f"WHEN {contains_any('lower(text)', words)} THEN ['{t}', '{s}']" for words, t, s in C.PROSE_CLASSES)}
      ELSE ['quality', 'MEDIUM'] END AS class,
    (row_number() OVER (PARTITION BY report_id ORDER BY rule) - 1)::INTEGER AS place
  FROM prose_lines WHERE {contains_any('lower(text)', C.PROSE_WORDS)}),
model AS (
  SELECT repo_id, report_id, (k - 1)::INTEGER AS rule,
    CASE WHEN conv_id % 2 = 0 THEN 'main.py' ELSE 'f' || conv_id || '.py' END AS path, (turn + k)::INTEGER AS line,
    {pick(['HIGH', 'MEDIUM', 'LOW'], '(turn + k)')} AS severity, text AS issue,
    {pick(['security', 'quality', 'accessibility', 'testability'], '(conv_id + k)')} AS type
  FROM (SELECT *, unnest(range(1, conv_id % 3 + 2)) AS k FROM responses WHERE turn % 3 = 0)
  UNION ALL
  SELECT repo_id, report_id, place, 'detected_file', 1, class[2], left({strip('text')}, 100), class[1]
  FROM prose)"""
_TOOL = "repo_id, report_id, rule, path, line, severity, issue, type"
SQL["ingest_bandit_json"] = with_(B.FILES, TOOLS) + f"SELECT {_TOOL} FROM bandit"
SQL["ingest_pylint_json"] = with_(B.FILES, TOOLS) + f"SELECT {_TOOL} FROM pylint"
SQL["ingest_semgrep_json"] = with_(B.FILES, TOOLS) + \
    f"SELECT {_TOOL}, \"column\", code_snippet, rule_id, description, tool FROM semgrep"
SQL["ingest_llm_json"] = with_(B.FILES, TOOLS) + f"SELECT {_TOOL} FROM model"
_JSON_PROSE = """
whole AS (SELECT repo_id, report_id, 'Found these:' || chr(10) || '{"issues":[' || array_to_string(
    list_transform(range(1, conv_id % 3 + 2), lambda k: '{"file":"' ||
      CASE WHEN conv_id % 2 = 0 THEN 'main.py' ELSE 'f' || conv_id || '.py' END || '","line":' || turn + k
      || ',"type":"' || (['security', 'quality', 'accessibility', 'testability'])[1 + (conv_id + k) % 4]
      || '","severity":"' || (['HIGH', 'MEDIUM', 'LOW'])[1 + (turn + k) % 3] || '","issue":'
      || to_json(text)::VARCHAR || '}'), ',') || ']}' || chr(10) || 'Done.' AS report
  FROM responses WHERE turn % 3 = 0),
all_lines AS (
  SELECT repo_id, report_id, unnest(range(0, len(string_split(report, chr(10)))))::INTEGER AS rule,
    unnest(string_split(report, chr(10))) AS text FROM (SELECT * FROM whole UNION ALL
      SELECT repo_id, report_id, report FROM responses WHERE report IS NOT NULL)),
classed AS (SELECT *, CASE """ + " ".join(
    f"WHEN {contains_any('lower(text)', w)} THEN ['{t}', '{s}']" for w, t, s in C.PROSE_CLASSES) + f"""
    ELSE ['quality', 'MEDIUM'] END AS class FROM all_lines WHERE {contains_any('lower(text)', C.PROSE_WORDS)})"""
SQL["classify_text_lines"] = with_(B.FILES, TOOLS, _JSON_PROSE) + \
    "SELECT repo_id, report_id, rule, class[1] AS type, class[2] AS severity FROM classed"
SQL["cap_llm_lines"] = with_(B.FILES, TOOLS, _JSON_PROSE) + f"""
SELECT repo_id, report_id, (place - 1)::INTEGER AS rule, left({strip('text')}, 100) AS issue, class[1] AS type,
  class[2] AS severity
FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY rule) AS place FROM classed) WHERE place <= 20"""
_CAP = "QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY report_id, rule) <= 10"
SQL["cap_tool_findings"] = with_(B.FILES, TOOLS) + f"""SELECT 'bandit' AS tool, {_TOOL} FROM bandit {_CAP}
UNION ALL SELECT 'pylint', {_TOOL} FROM pylint {_CAP}"""
_SNIPPET = f"""coalesce((SELECT any_value({strip('raw')}) FROM lines0 l
  WHERE l.repo_id = t.repo_id AND l.path = ltrim(t.path, '/') AND l.line = t.line), '')"""
SQL["snippet_lookup"] = with_(B.SPLIT, TOOLS) + f"""SELECT t.*, {_SNIPPET} AS code_snippet FROM (
  SELECT 'bandit' AS tool, {_TOOL} FROM bandit UNION ALL SELECT 'pylint', {_TOOL} FROM pylint
  UNION ALL SELECT 'model', {_TOOL} FROM model) t"""
SQL["tool_or_rules"] = with_(B.LINES, B.group_cte(R.QUALITY), TOOLS) + f"""
SELECT repo_id, path, line, severity, issue, type, {_SNIPPET} AS code_snippet FROM pylint t
UNION ALL SELECT {FINDING} FROM quality_rows WHERE repo_id NOT IN (SELECT repo_id FROM pylint)"""

# --- test reports -----------------------------------------------------------

TESTS = REPORTS + f""",
bodies AS (
  SELECT *, NOT is_array AND NOT is_other AS full_body,
    CASE WHEN d % 3 <> 2 THEN (d % 4 + 1)::VARCHAR END AS total_tests,
    CASE WHEN d % 3 = 2 THEN (d % 4 + 1)::VARCHAR END AS total,
    CASE WHEN d % 6 <> 5 THEN (d % 4)::VARCHAR END AS passed, CASE WHEN d % 5 <> 4 THEN '1' END AS failed,
    CASE WHEN d % 4 = 0 THEN 'en/' || repo_id END AS repository, {pick(T.COVERAGES, 'd')} AS coverage_percent,
    CASE WHEN d % 9 <> 8 THEN (d % 4 + 1)::INTEGER ELSE 0 END AS tests
  FROM owned),
details AS (
  SELECT *, 'test_' || d || '_' || k AS name_k,
    ([path, './' || path, 'gone/x' || d || '.py', 'old/main.py'])[1 + (d + k) % 4] AS file_k,
    (['PASSED', 'FAILED', 'SKIPPED'])[1 + (d + k) % 3] AS status_k,
    CASE WHEN d % 3 <> 0 THEN (k + 1) || 's' ELSE 'N/A' END AS duration_k,
    CASE WHEN d % 2 = 0 THEN 'say "no" at ' || path ELSE 'Test failed' END AS error_k
  FROM (SELECT *, unnest(range(0, tests)) AS k FROM bodies WHERE full_body)),
coverages AS (
  SELECT repo_id, report_id, CASE coverage_percent WHEN '85.5%' THEN 85.5 WHEN ' 40 ' THEN 40 WHEN '12.25' THEN 12.25
    ELSE 0 END::DOUBLE AS coverage, CASE WHEN full_body THEN coverage_percent END AS coverage_percent, full_body FROM bodies)
"""
_FIELDS = ("repository", "total_tests", "total", "passed", "failed", "coverage_percent")
SQL["ingest_test_report"] = with_(TESTS) + "SELECT repo_id, report_id, CASE WHEN full_body THEN 'Python' END AS language, " + ", ".join(
    f"CASE WHEN full_body THEN {f} END AS {f}" for f in _FIELDS) + \
    ", CASE WHEN full_body THEN tests ELSE 0 END AS tests FROM bodies"
SQL["test_summary"] = with_(TESTS) + """SELECT repo_id, report_id,
  CASE WHEN full_body THEN (d % 4 + 1)::VARCHAR ELSE 'N/A' END AS total_tests,
  CASE WHEN full_body AND passed IS NOT NULL THEN passed ELSE 'N/A' END AS passed,
  CASE WHEN full_body AND failed IS NOT NULL THEN failed ELSE 'N/A' END AS failed,
  CASE WHEN full_body AND coverage_percent IS NOT NULL THEN coverage_percent ELSE 'N/A' END AS coverage FROM bodies"""
SQL["parse_coverage"] = with_(TESTS) + """SELECT repo_id, report_id, coverage_percent,
  CASE WHEN full_body THEN coverage ELSE 0 END AS coverage FROM coverages"""
SQL["failed_tests"] = with_(TESTS) + """SELECT repo_id, report_id, name_k AS name, error_k AS error, duration_k AS duration
  FROM details WHERE status_k = 'FAILED'"""
SQL["report_structure_ok"] = with_(TESTS) + "SELECT repo_id, report_id, full_body AND (" \
    "d % 3 <> 2 OR passed IS NOT NULL OR coverage_percent IS NOT NULL OR d % 6 = 0 OR tests > 0) AS ok FROM bodies"
PATHS = TESTS + """,
paths AS MATERIALIZED (
  SELECT DISTINCT repo_id, report_id, path FROM (
    SELECT repo_id, report_id, file_k AS path FROM details
    UNION ALL SELECT repo_id, report_id, unnest([path, 'lost/' || path]) FROM bodies WHERE full_body AND d % 6 = 0)),
existing AS (
  SELECT repo_id, path FROM files
  UNION SELECT repo_id, array_to_string(string_split(path, '/')[:n], '/')
  FROM (SELECT repo_id, path, unnest(range(0, len(string_split(path, '/')))) AS n FROM files)),
checked AS MATERIALIZED (
  SELECT p.*, EXISTS (SELECT 1 FROM existing e WHERE e.repo_id = p.repo_id AND
      (e.path = rtrim(clean, '/') OR e.path = string_split(clean, '/')[-1]
       OR e.path = rtrim(p.path, '/') AND NOT starts_with(p.path, '/'))) AS found
  FROM (SELECT *, ltrim(trim(path), './') AS clean FROM paths) p)"""
SQL["distinct_report_paths"] = with_(PATHS) + "SELECT * FROM paths"
SQL["report_paths_found"] = with_(PATHS) + "SELECT repo_id, report_id, path, clean, found FROM checked"
SQL["report_matches_repo"] = with_(PATHS) + """,
counted AS (
  SELECT r.repo_id, r.report_id, count(*) FILTER (found) AS files_found, count(clean) AS total_files,
    coalesce((list(clean ORDER BY clean, c.path) FILTER (NOT found))[:5], []) AS missing
  FROM reports r LEFT JOIN checked c USING (repo_id, report_id) GROUP BY ALL),
judged AS (SELECT *, total_files >= 3 AND files_found * 100.0 / total_files < 30 AS fails FROM counted)
SELECT repo_id, report_id, files_found, total_files, array_to_string(missing, '|') AS missing, NOT fails AS matches,
  CASE WHEN fails THEN 'Unit test report does not match repository. Only ' || files_found || '/' || total_files
    || ' test files found in repository. Missing files: ' || array_to_string(missing[:3], ', ') || '...' ELSE '' END AS message
FROM judged"""
SQL["report_metadata_match"] = with_(TESTS) + """,
candidates AS (
  SELECT *, list_filter([CASE WHEN d % 4 = 0 THEN 'en/' || repo_id END, CASE WHEN d % 3 = 1 THEN 'team/' || repo_id END,
    CASE WHEN d % 5 = 1 THEN 'x/' || repo_id END, CASE WHEN d % 7 = 1 THEN repo_id END,
    CASE WHEN d % 6 = 0 THEN 'lost/' || path END], lambda x: x IS NOT NULL AND full_body) AS found FROM bodies)
SELECT repo_id, report_id, repo AS repo_name, len(found) AS metadata_fields,
  len(list_filter(found, lambda x: contains(lower(x), repo))) > 0 AS metadata_matches FROM candidates"""

# --- the combined findings --------------------------------------------------

ALL = B.OWN + "," + B.GATES + "," + TOOLS + f""",
combined AS (
  SELECT 'rules' AS tool, "rank", NULL::BIGINT AS report_id, rule, {FINDING} FROM own
  WHERE NOT ("rank" IN (10, 11) AND repo_id IN (SELECT repo_id FROM bandit))
    AND NOT ("rank" = 20 AND repo_id IN (SELECT repo_id FROM pylint))
  UNION ALL SELECT 'bandit', 10, report_id, rule, repo_id, path, line, severity, issue, type, {_SNIPPET} FROM bandit t
  UNION ALL SELECT 'pylint', 20, report_id, rule, repo_id, path, line, severity, issue, type, {_SNIPPET} FROM pylint t
  UNION ALL SELECT tool, 30, report_id, rule, repo_id, path, line, severity, issue, type, code_snippet FROM semgrep
  UNION ALL SELECT 'model', 40, report_id, rule, repo_id, path, line, severity, issue, type, {_SNIPPET} FROM model t),
findings AS MATERIALIZED (
  SELECT c.* FROM combined c LEFT JOIN gates USING (repo_id)
  WHERE ("rank" NOT IN (10, 11, 20) OR has_python) AND ("rank" <> 30 OR has_code))"""
_F = with_(ALL)
SQL["union_findings"] = _F + f"SELECT tool, \"rank\" AS source_rank, report_id, {FINDING} FROM findings"
SQL["gate_by_language"] = with_(B.OWN, B.GATES) + f"""SELECT {FINDING} FROM own JOIN gates USING (repo_id)
  WHERE "rank" NOT IN (10, 11, 20) OR has_python"""
SQL["dedup_exact"] = with_(B.LINES, B.group_cte(R.SECURITY)) + f"""
SELECT {FINDING} FROM security_rows QUALIFY row_number() OVER (PARTITION BY repo_id, path, line, issue) = 1"""
SQL["first_per_message"] = with_(B.LINES, B.group_cte(R.SECURITY), B.group_cte(R.QUALITY)) + f"""
SELECT {FINDING} FROM (SELECT * FROM security_rows UNION ALL SELECT * FROM quality_rows)
QUALIFY row_number() OVER (PARTITION BY repo_id, path, type, issue ORDER BY line) = 1"""
SQL["advanced_not_seen"] = with_(B.LINES, B.group_cte(R.SECURITY), B.group_cte(R.ADVANCED)) + f"""
SELECT {FINDING} FROM advanced_rows a WHERE severity <> 'HIGH' AND NOT EXISTS (SELECT 1 FROM security_rows s
  WHERE s.repo_id = a.repo_id AND s.path = a.path AND s.line = a.line AND s.issue = a.issue)"""
SQL["drop_empty_issues"] = _F + f"SELECT tool, {FINDING} FROM findings WHERE trim(coalesce(issue, '')) <> ''"
SQL["critical_list"] = _F + f"SELECT {FINDING} FROM findings WHERE type = 'security' AND severity = 'CRITICAL'"


def _fix_case(field: int) -> str:
    low = "lower(issue)"
    rows = []
    for groups, *texts in C.FIXES:
        rows.append(f"WHEN {' AND '.join(contains_any(low, g) for g in groups)} THEN {lit(texts[field])}")
    title, rename, arrow, why = C.RENAME_FIX
    renamed = [lit(title), f"{lit(rename)} || path || {lit(arrow)} || replace(replace(replace(path, ' ', '_'), 'á', 'a'), 'é', 'e')",
               lit(why)][field]
    prefix, code, why = C.OTHER_FIX
    other = [f"{lit(prefix)} || issue", lit(code), f"{lit(why)} || issue"][field]
    return (f"CASE WHEN contains({low}, 'filename') AND (contains({low}, 'space') OR contains({low}, 'accent')) "
            f"THEN {renamed} {' '.join(rows)} ELSE {other} END")


_FIXED = "tool IN ('rules', 'bandit')"
SQL["minimal_fix"] = _F + f"""SELECT repo_id, path, line, issue, {_fix_case(0)} AS suggestion,
  {_fix_case(1)} AS minimal_code, {_fix_case(2)} AS explanation FROM findings WHERE {_FIXED}"""
SQL["by_type"] = _F + "SELECT repo_id, type, count(*) AS issues FROM findings GROUP BY repo_id, type"
SQL["by_severity"] = _F + "SELECT repo_id, severity, count(*) AS issues FROM findings GROUP BY repo_id, severity"
SQL["by_file"] = _F + "SELECT repo_id, path, count(*) AS issues FROM findings GROUP BY repo_id, path"
SQL["breakdown"] = _F + """SELECT repo_id, dimension, value, count(*) AS issues FROM (
  SELECT repo_id, 'type' AS dimension, type AS value FROM findings UNION ALL
  SELECT repo_id, 'severity', severity FROM findings UNION ALL SELECT repo_id, 'file', path FROM findings)
GROUP BY ALL"""
SQL["top_files"] = _F + """SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY issues DESC, first_rank, path)::INTEGER AS place,
  path, issues FROM (SELECT repo_id, path, count(*) AS issues, min("rank") AS first_rank FROM findings GROUP BY ALL)
QUALIFY place <= 5"""

REPOS = f"""
repos AS (SELECT source AS repo_id, 'https://github.com/team/' || source ||
    (['-api', '-web.git', '-lib', ''])[1 + min(doc_id) % 4] AS repo_url FROM documents GROUP BY source)"""


def _counts(source: str, key: str) -> str:
    """Counts per key as CTE ``counts``, with the scores in ``metrics``."""
    types = ", ".join(f"count(*) FILTER (type = '{t}') AS {t}_issues" for t in M.ISSUE_TYPES)
    severities = ", ".join(f"count(*) FILTER (severity = '{s.upper()}') AS {s}_issues"
                           for s in ("critical", "high", "medium", "low"))
    return f"""
counts AS (SELECT {key} AS repo_id, count(type) AS total_issues, {types}, {severities},
    count(*) FILTER (type = 'security' AND severity = 'CRITICAL') AS critical_security,
    count(*) FILTER (contains(lower(issue), 'filename')) AS filename_issues,
    count(*) FILTER (contains(lower(issue), 'snake_case')) AS snake_issues,
    count(*) FILTER (contains(path, '.js')) AS js_paths, count(*) FILTER (contains(path, '.java')) AS java_paths,
    count(*) FILTER ({_FIXED}) AS fixes,
    coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 1 END)
      FILTER (type IS NOT NULL), 0)::BIGINT AS effort_points
  FROM {source} GROUP BY 1),
scored AS (SELECT *, greatest(0, 100 - security_issues * 15) AS security_score,
    greatest(0, 100 - quality_issues * 10) AS quality_score,
    greatest(0, 100 - performance_issues * 10) AS performance_score,
    greatest(0, 100 - quality_issues * 5) AS maintainability_index,
    CASE WHEN critical_issues > 0 THEN 'CRITICAL' WHEN high_issues > 2 THEN 'HIGH'
         WHEN total_issues > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN critical_issues = 0 AND high_issues < 3 THEN 'PASS' ELSE 'FAIL' END AS compliance_status,
    CASE WHEN effort_points < 10 THEN 'LOW (1-2 days)' WHEN effort_points < 25 THEN 'MEDIUM (3-5 days)'
         WHEN effort_points < 50 THEN 'HIGH (1-2 weeks)' ELSE 'VERY HIGH (2+ weeks)' END AS remediation_effort
  FROM counts)"""


_BY_REPO = ALL + "," + REPOS + "," + _counts("repos LEFT JOIN findings USING (repo_id)", "repo_id")
_BY_FILE = ALL + "," + _counts("findings", "repo_id || '/' || path")
_COVERED = _BY_REPO + "," + TESTS.replace(B.FILES + ",", "") + """,
latest AS (SELECT repo_id, arg_max(CASE WHEN full_body THEN coverage ELSE 0 END, report_id) AS test_coverage
  FROM coverages GROUP BY repo_id),
metrics AS (SELECT s.*, coalesce(test_coverage, 0) AS test_coverage,
    round(total_issues / greatest(1.0, coalesce(test_coverage, 0) / 10), 2) AS issue_density
  FROM scored s LEFT JOIN latest USING (repo_id))"""
_OVERALL = "round((security_score + quality_score + performance_score) / 3, 1) AS overall_score"
SQL["raw_counts"] = with_(_BY_REPO) + "SELECT repo_id, total_issues, " + ", ".join(
    f"{t}_issues" for t in M.ISSUE_TYPES) + ", critical_issues, high_issues FROM counts"
SQL["scores"] = with_(_BY_REPO) + f"""SELECT repo_id, security_score, quality_score, performance_score, {_OVERALL} FROM scored"""
SQL["file_scores"] = with_(_BY_FILE) + f"""SELECT repo_id, security_score, quality_score, performance_score, {_OVERALL},
  risk_level, remediation_effort, compliance_status, total_issues::DOUBLE AS issue_density, maintainability_index FROM scored"""
SQL["risk_level"] = with_(_BY_REPO) + "SELECT repo_id, risk_level FROM scored"
SQL["remediation_effort"] = with_(_BY_REPO) + "SELECT repo_id, effort_points, remediation_effort FROM scored"
SQL["compliance"] = with_(_BY_REPO) + "SELECT repo_id, compliance_status FROM scored"
SQL["issue_density"] = with_(_COVERED) + "SELECT repo_id, test_coverage, issue_density FROM metrics"
SQL["maintainability_index"] = with_(_BY_REPO) + "SELECT repo_id, maintainability_index FROM scored"
_SUMMARY = """CASE risk_level
    WHEN 'CRITICAL' THEN 'CRITICAL SECURITY RISKS DETECTED: ' || security_issues || ' security vulnerabilities found requiring immediate attention.'
    WHEN 'HIGH' THEN 'HIGH RISK: ' || total_issues || ' issues identified with significant security and quality concerns.'
    WHEN 'MEDIUM' THEN 'MODERATE RISK: ' || total_issues || ' issues found with manageable security and quality improvements needed.'
    ELSE 'LOW RISK: ' || total_issues || ' minor issues identified. Overall code quality is acceptable.' END
  || ' Overall security score: ' || security_score || '/100. Estimated remediation effort: ' || remediation_effort || '.'"""
SQL["executive_summary"] = with_(_BY_REPO) + f"SELECT repo_id, {_SUMMARY} AS summary FROM scored"
_IMPACT = ", ".join(
    f"CASE risk_level WHEN 'CRITICAL' THEN {lit(M.IMPACTS['CRITICAL'][i])} WHEN 'HIGH' THEN {lit(M.IMPACTS['HIGH'][i])} "
    f"ELSE {lit(M.IMPACT_OTHER[i])} END AS {n}"
    for i, n in enumerate(("business_impact", "deployment_recommendation", "timeline")))
SQL["impact_assessment"] = with_(_BY_FILE) + f"SELECT repo_id, {_IMPACT} FROM scored"
_PROFILED = _BY_REPO + """,
profiled AS (SELECT c.*, string_split(replace(repo_url, '.git', ''), '/')[-1] AS name,
    string_split(replace(repo_url, '.git', ''), '/')[-2] AS owner,
    CASE WHEN js_paths > 0 THEN 'javascript' WHEN java_paths > 0 THEN 'java' ELSE 'python' END AS language
  FROM counts c JOIN repos USING (repo_id))"""
_PROJECT = """CASE WHEN regexp_matches(lower(name), 'api|service') THEN 'api_service'
    WHEN regexp_matches(lower(name), 'web|frontend') THEN 'web_application'
    WHEN regexp_matches(lower(name), 'lib|package') THEN 'library' ELSE 'application' END"""
SQL["repo_profile"] = with_(_PROFILED) + f"""SELECT repo_id, name, owner, language, {_PROJECT} AS project_type,
  CASE WHEN total_issues < 10 THEN 'medium' ELSE 'high' END AS complexity FROM profiled"""


def _areas(kind: str, table) -> str:
    names = [n for n, _ in table] + [C.OTHER_AREA]
    case = " ".join(f"WHEN {contains_any('lower(issue)', w)} THEN '{n}'" for n, w in table)
    return "SELECT repo_id, " + ", ".join(f"count(*) FILTER (area = '{n}') AS {n}" for n in names) + \
        f" FROM (SELECT repo_id, CASE {case} ELSE 'other' END AS area FROM findings WHERE type = '{kind}') GROUP BY repo_id"


SQL["security_subcategory"] = _F + _areas("security", C.SECURITY_AREAS)
SQL["quality_subcategory"] = _F + _areas("quality", C.QUALITY_AREAS)
SQL["fix_count"] = with_(_BY_REPO) + "SELECT repo_id, fixes FROM counts"
SQL["trend"] = with_(_BY_REPO) + """SELECT repo_id, CASE WHEN quality_issues > security_issues THEN 'quality' ELSE 'security' END
  AS most_common_issue_type, critical_issues AS critical, high_issues AS high, medium_issues AS medium, low_issues AS low FROM counts"""
_RECOMMEND = """
recommended AS (SELECT repo_id, (row_number() OVER (PARTITION BY repo_id ORDER BY o))::INTEGER AS position,
  priority, category, title, description, effort FROM (
    SELECT repo_id, 1 AS o, 'CRITICAL' AS priority, 'Security' AS category, 'Address Critical Security Vulnerabilities' AS title,
      'Fix ' || critical_security || ' critical security issues immediately before deployment.' AS description, 'HIGH' AS effort
    FROM profiled WHERE critical_security > 0
    UNION ALL SELECT repo_id, 2, 'HIGH', 'Code Quality', 'Improve Code Quality Standards',
      'Address ' || quality_issues || ' quality issues to improve maintainability.', 'MEDIUM' FROM profiled WHERE quality_issues > 5
    UNION ALL SELECT repo_id, 3, 'HIGH', 'Infrastructure', 'Fix File Naming Issues',
      'Rename files with spaces/accents to prevent deployment issues on Linux systems.', 'LOW' FROM profiled WHERE filename_issues > 0
    UNION ALL SELECT repo_id, 4, 'MEDIUM', 'Python Standards', 'Follow Python Naming Conventions',
      'Use snake_case for functions and PascalCase for classes as per PEP 8.', 'LOW' FROM profiled
      WHERE language = 'python' AND snake_issues > 0))"""
SQL["recommendations"] = with_(_PROFILED, _RECOMMEND) + "SELECT * FROM recommended"
_SECTION = """CASE WHEN type = 'performance' THEN 'performance' WHEN type IN ('best_practice', 'maintainability') THEN 'best_practices'
  WHEN type IN ('documentation', 'accessibility', 'testability') THEN 'documentation' END"""
SQL["assessment_rollup"] = _F + f"""SELECT repo_id, {_SECTION} AS section, type, count(*) AS issues FROM findings
  WHERE {_SECTION} IS NOT NULL GROUP BY ALL"""
SQL["assessment_findings"] = _F + f"SELECT {_SECTION} AS section, {FINDING} FROM findings WHERE {_SECTION} IS NOT NULL"

# --- structure --------------------------------------------------------------

_REPO_LIST = "repo_list AS (SELECT DISTINCT repo_id FROM files)"
SQL["scan_stats"] = with_(B.FILES, _REPO_LIST) + f""",
dirs AS (SELECT DISTINCT repo_id, string_split(path, '/')[:n] AS dir
  FROM (SELECT repo_id, path, unnest(range(1, len(string_split(path, '/')))) AS n FROM files)),
shown AS (SELECT * FROM dirs WHERE len(list_filter(dir, lambda x: starts_with(x, '.') OR x IN ({items(R.IGNORED_DIRS)}))) = 0)
SELECT repo_id, (SELECT count(*) FROM files f WHERE f.repo_id = r.repo_id AND {VISIBLE}) AS files_scanned,
  (SELECT count(*) FROM shown s WHERE s.repo_id = r.repo_id) AS directories_scanned FROM repo_list r"""
SQL["count_code_files"] = with_(B.FILES) + f"""SELECT repo_id,
  count(*) FILTER (NOT {B.IGNORED} AND {B.ends_any('path', R.CODE_EXTENSIONS)}) AS code_files FROM files GROUP BY repo_id"""
ROLES = f"""
roles AS (SELECT *, is_python AND contains(lower(path), 'test') AS is_test,
    is_python AND NOT contains(lower(path), 'test') AND lower(path) IN ({items(S.MAIN_MODULES)}) AS is_main
  FROM (SELECT repo_id, path, ends_with(path, '.py') AS is_python,
    NOT ends_with(path, '.py') AND {B.ends_any('path', R.CONFIG_EXTENSIONS)} AS is_config FROM files WHERE {VISIBLE}))"""
SQL["project_structure"] = with_(B.FILES, ROLES) + \
    "SELECT repo_id, path, is_python, is_test, is_main, is_config FROM roles WHERE is_python OR is_config"
SQL["structure_suggestions"] = with_(B.FILES, ROLES, _REPO_LIST) + f""",
counted AS (SELECT r.repo_id, count(*) FILTER (is_python) AS py, count(*) FILTER (is_config) AS cfg
  FROM repo_list r LEFT JOIN roles USING (repo_id) GROUP BY r.repo_id)
SELECT * FROM (SELECT repo_id, CASE WHEN {contains_any('lower(path)', S.ESSENTIAL)} THEN 'minimal_file'
    WHEN {contains_any('lower(path)', S.REMOVABLE)} THEN 'removable_file' END AS kind, path AS value
  FROM roles WHERE is_python OR is_config) WHERE kind IS NOT NULL
UNION ALL SELECT repo_id, 'improvement', {lit(S.MANY_PYTHON_ADVICE)} FROM counted WHERE py > 5
UNION ALL SELECT repo_id, 'improvement', {lit(S.MANY_CONFIG_ADVICE)} FROM counted WHERE cfg > 3
UNION ALL SELECT repo_id, 'improvement', unnest([{items(S.STANDING_ADVICE)}]) FROM counted"""
SQL["accuracy_metrics"] = with_(_BY_REPO, ROLES) + """,
per_repo AS (SELECT c.repo_id, c.total_issues, count(r.path) AS files, count(*) FILTER (is_python) AS py,
    count(*) FILTER (is_test) AS test_files FROM counts c LEFT JOIN roles r USING (repo_id) GROUP BY ALL),
measured AS (SELECT *, least(100.0::DOUBLE, files::DOUBLE / greatest(1, py) * 20) AS depth,
    total_issues::DOUBLE / greatest(1, py) AS density FROM per_repo)
SELECT repo_id, files AS files_analyzed, py AS code_files, test_files,
  round(least(98.0::DOUBLE, 75.0 + depth + density * 5), 6) AS detection_accuracy,
  round(greatest(2.0::DOUBLE, 20.0 - depth - density * 2), 6) AS false_positive_rate,
  round(least(100.0::DOUBLE, 60.0 + depth + total_issues * 2), 6) AS scan_completeness FROM measured"""

# --- reports ----------------------------------------------------------------

_NUMBERED = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY "rank", path, line, report_id NULLS FIRST, rule) AS n,
    {_FIXED} AS fixed FROM findings)"""
_COUNTERS = ", ".join(f"'{t}_issues', {t}_issues" for t in M.ISSUE_TYPES)
SQL["report_json"] = with_(_BY_REPO, _NUMBERED) + f"""
SELECT repo_id, 0 AS n, json_object('repo_id', repo_id, 'total_issues', total_issues, {_COUNTERS})::VARCHAR AS report
FROM counts
UNION ALL
SELECT repo_id, n, json_object('path', path, 'line', line, 'severity', severity, 'issue', issue,
    'type', type, 'code_snippet', code_snippet, 'minimal_fix', CASE WHEN fixed THEN json_object(
      'suggestion', {_fix_case(0)}, 'minimal_code', {_fix_case(1)}, 'explanation', {_fix_case(2)}) END)::VARCHAR
FROM numbered"""


SQL["report_documents"] = f"""WITH rows AS ({SQL["report_json"]})
SELECT repo_id, n, CASE WHEN n = 0 THEN left(report, length(report) - 1) || ',"issues":[' WHEN n = 1 THEN report ELSE ',' || report END AS text
FROM rows
UNION ALL SELECT repo_id, count(*) AS n, ']}}' AS text FROM rows GROUP BY repo_id"""


def _nl(*parts) -> str:
    return " || ".join(f"{p} || chr(10)" for p in parts)


def _area_lines(kind: str, table) -> str:
    rows = []
    for n in [n for n, _ in table] + [C.OTHER_AREA]:
        rows.append(f"CASE WHEN {kind}_{n} > 0 THEN '• {n.title()}: ' || {kind}_{n} || ' issues' || chr(10) ELSE '' END")
    return " || ".join(rows)


def _area_counts(kind: str, table) -> str:
    case = " ".join(f"WHEN {contains_any('lower(issue)', w)} THEN '{n}'" for n, w in table)
    return ", ".join(f"count(*) FILTER (type = '{kind}' AND {kind}_area = '{n}') AS {kind}_{n}"
                     for n in [n for n, _ in table] + [C.OTHER_AREA]), f"CASE {case} ELSE 'other' END AS {kind}_area"


_SA, _SC = _area_counts("security", C.SECURITY_AREAS)
_QA, _QC = _area_counts("quality", C.QUALITY_AREAS)
_HEADER = " || ".join([
    _nl(*[lit(x) for x in (*P.TITLE, "", *P.REPOSITORY)], "'Repository: ' || repo_url", "'Scan ID: ' || repo_id",
        "'Scan Date: 2024-02-01'", f"'Repository Type: ' || {_PROJECT}", "'Primary Language: ' || language", "''",
        *[lit(x) for x in P.SUMMARY], _SUMMARY, "''", *[lit(x) for x in P.METRICS],
        "'Overall Score: ' || overall_score || '/100'", "'Security Score: ' || security_score || '/100'",
        "'Quality Score: ' || quality_score || '/100'", "'Performance Score: ' || performance_score || '/100'",
        "'Risk Level: ' || risk_level", "'Test Coverage: ' || CASE WHEN test_coverage = 0 THEN '0' ELSE test_coverage::VARCHAR END || '%'",
        "'Compliance Status: ' || compliance_status", "'Remediation Effort: ' || remediation_effort", "''",
        *[lit(x) for x in P.SECURITY], "'Total Security Issues: ' || security_issues",
        "'Security Score: ' || security_score || '/100'", "'Compliance Status: ' || compliance_status", "''",
        "'Security Categories:'"),
    _area_lines("security", C.SECURITY_AREAS),
    _nl("''", "''", *[lit(x) for x in P.QUALITY], "'Total Quality Issues: ' || quality_issues",
        "'Quality Score: ' || quality_score || '/100'", "'Maintainability Index: ' || maintainability_index || '/100'",
        "''", "'Quality Categories:'"),
    _area_lines("quality", C.QUALITY_AREAS),
    _nl("''", *[lit(x) for x in P.PERFORMANCE], "'Total Performance Issues: ' || performance_issues",
        "'Performance Score: ' || performance_score || '/100'", "''", *[lit(x) for x in P.PRACTICES],
        "'Best Practice Issues: ' || best_practice_issues", "'Maintainability Issues: ' || maintainability_issues", "''",
        *[lit(x) for x in P.ADDITIONAL], "'Documentation Issues: ' || documentation_issues",
        "'Accessibility Issues: ' || accessibility_issues", "'Testability Issues: ' || testability_issues", "''",
        *[lit(x) for x in P.RECOMMENDATIONS]),
    "coalesce(advice, '')", _nl("''", *[lit(x) for x in P.ISSUES])])
_TITLES = " ".join(f"WHEN '{t}' THEN '{t.title()}'" for t in M.ISSUE_TYPES)
SQL["report_text"] = with_(_COVERED, _NUMBERED,
                           _PROFILED.replace(_BY_REPO + ",", "", 1), _RECOMMEND) + f""",
area_counts AS (SELECT repo_id, {_SA}, {_QA} FROM (
    SELECT r.repo_id, type, {_SC}, {_QC} FROM repos r LEFT JOIN findings f USING (repo_id)) GROUP BY repo_id),
advised AS (SELECT repo_id, string_agg(position || '. [' || priority || '] ' || title || chr(10) || '   Category: ' || category
    || chr(10) || '   Description: ' || description || chr(10) || '   Effort: ' || effort || chr(10) || chr(10), '' ORDER BY position)
    AS advice FROM recommended GROUP BY repo_id),
facts AS (SELECT m.*, {_OVERALL}, p.name, p.language, r.repo_url, a.* EXCLUDE (repo_id), advice
  FROM metrics m JOIN profiled p USING (repo_id) JOIN repos r USING (repo_id) JOIN area_counts a USING (repo_id)
  LEFT JOIN advised USING (repo_id)),
parts AS (
  SELECT repo_id, 0 AS n, {_HEADER} AS text FROM facts
  UNION ALL
  SELECT repo_id, n, n || '. [' || severity || '] ' || issue || chr(10) || '   File: ' || path || ' (Line ' || line || ')'
    || chr(10) || '   Type: ' || CASE type {_TITLES} END || chr(10)
    || CASE WHEN code_snippet <> '' THEN '   Code: ' || code_snippet || chr(10) ELSE '' END
    || CASE WHEN fixed THEN '   Fix: ' || {_fix_case(0)} || chr(10) ELSE '' END || chr(10)
  FROM numbered WHERE trim(coalesce(issue, '')) <> '')
SELECT * FROM parts"""

SQL["basic_report_text"] = with_(_BY_REPO, _NUMBERED) + f"""
SELECT * FROM (
  SELECT repo_id, 0 AS n, {_nl("'BASIC SCAN REPORT'", "'================='", "''", "'Repository: ' || repo_url",
    "'Job ID: ' || repo_id", "'Completed: 2024-02-01'", "''", "'SUMMARY'", "'-------'", "'Total Issues: ' || total_issues",
    "'Security Issues: ' || security_issues", "'Quality Issues: ' || quality_issues", "''", "'DETAILED ISSUES'",
    "'---------------'")} AS text FROM counts JOIN repos USING (repo_id)
  UNION ALL
  SELECT repo_id, n, n || '. ' || upper(type) || ': ' || issue || chr(10) || '   File: ' || path || ' (Line ' || line || ')'
    || chr(10) || '   Severity: ' || severity || chr(10)
    || CASE WHEN code_snippet <> '' THEN '   Code: ' || code_snippet || chr(10) ELSE '' END || chr(10)
  FROM numbered WHERE trim(coalesce(issue, '')) <> '')"""
_DIRS, _STATS = SQL["scan_stats"].split(_REPO_LIST, 1)[1].rsplit("\nSELECT repo_id, (SELECT", 1)
SQL["scan_rows"] = with_(_BY_REPO, _REPO_LIST) + f"""{_DIRS}, stats AS (SELECT repo_id, (SELECT{_STATS})
SELECT repo_id || '@2024-02-01 00:00:00' AS job_id, 1 AS user_id, repo_url, 'completed' AS status, total_issues,
  security_issues, quality_issues, files_scanned, directories_scanned, TIMESTAMP '2024-02-01' AS created_at,
  TIMESTAMP '2024-02-01' AS updated_at, TIMESTAMP '2024-02-01' AS completed_at
FROM repos JOIN counts USING (repo_id) JOIN stats USING (repo_id)"""

# --- scan history -----------------------------------------------------------

SCANS = f"""
scan_events AS (
  SELECT 'job-' || user_id AS job_id, nullif(user_id % 7, 0)::INTEGER AS user_id,
    'https://github.com/team/repo' || user_id % 11 AS repo_url,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
    (props->>'$.k')::INTEGER AS total_issues, (event_id % 13)::INTEGER AS security_issues,
    (event_id % 17)::INTEGER AS quality_issues, (event_id % 19)::INTEGER AS files_scanned,
    (event_id % 5)::INTEGER AS directories_scanned,
    CASE WHEN event_id % 3 <> 0 THEN '[{{"issue":"' || event_type || '","line":' || (props->>'$.k') || '}}]' END AS issues,
    CASE WHEN event_id % 4 <> 0 THEN '{{"total_tests":' || (props->>'$.k') || '}}' END AS unit_test_report,
    ts AS created_at, ts AS updated_at, CASE WHEN event_type = 'purchase' THEN ts END AS completed_at, event_id,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 WHEN 'error' THEN 2 ELSE 1 END AS state
  FROM events),
scans AS MATERIALIZED (
  SELECT * EXCLUDE (event_id, state) REPLACE (first_value(created_at) OVER w AS created_at, first_value(user_id) OVER w AS user_id,
    first_value(repo_url) OVER w AS repo_url) FROM scan_events
  WINDOW w AS (PARTITION BY job_id ORDER BY updated_at, state, event_id)
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, state DESC, event_id DESC) = 1)"""
_S = with_(SCANS)
_ALL_SCANS = _S + "SELECT * FROM scans"
SQL["upsert_scans"] = _ALL_SCANS
SQL["stream_scan_status"] = SQL["scan_table_upsert"] = SQL["stream_scan_table"] = _ALL_SCANS
SQL["scan_store_rw"] = _S + "SELECT * REPLACE (coalesce(issues, '[]') AS issues) FROM scans"
SQL["get_scan"] = _S + "SELECT * FROM scans WHERE job_id = 'job-8' AND user_id = 1"
_LISTED = "repo_url, status, total_issues, security_issues, quality_issues, files_scanned, directories_scanned, created_at, completed_at"
SQL["recent_scans"] = _S + f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id)::INTEGER AS place,
  job_id, {_LISTED} FROM scans WHERE user_id IS NOT NULL QUALIFY place <= 50"""
SQL["scan_history"] = _S + f"""SELECT job_id, {_LISTED.replace('repo_url, ', '')} FROM scans
  WHERE repo_url = 'https://github.com/team/repo8' AND user_id = 1"""
SQL["delete_scan"] = _S + "SELECT job_id, user_id, status FROM scans WHERE NOT coalesce(status = 'failed' AND user_id = 3, false)"
SQL["clear_scans"] = _S + "SELECT job_id, user_id, status FROM scans WHERE user_id IS DISTINCT FROM 3"
SQL["scan_table_delete"], SQL["scan_table_clear"] = SQL["delete_scan"], SQL["clear_scans"]
SQL["visible_scans"] = _S + "SELECT job_id, user_id, status FROM scans WHERE user_id IS NULL OR user_id = 2"
SQL["active_scans"] = _S + "SELECT count(*) AS active_scans FROM scans WHERE status = 'running'"
SQL["scan_duration"] = _S + """SELECT job_id, (epoch_us(updated_at) - epoch_us(created_at)) / 1000000 AS seconds,
  printf('%.2fs', (epoch_us(updated_at) - epoch_us(created_at)) / 1000000) AS scan_duration FROM scans"""
SQL["stream_findings"] = with_(B.OWN, B.GATES) + f"""SELECT {FINDING},
  {_fix_case(0)} AS suggestion FROM own JOIN gates USING (repo_id) WHERE "rank" NOT IN (10, 11, 20) OR has_python"""
