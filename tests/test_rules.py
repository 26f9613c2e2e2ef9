import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from siftlake import rules as R
from siftlake.functions.text import MARKS, is_simple, linear_form, needed_literal, needed_texts
from siftlake.plans import scan
from siftlake.workload.bank import BANK

from tests import brute

LIVE = [(g.name, i, r) for g in R.ALL_GROUPS for i, r in enumerate(g.rules) if r.live]
DEAD = [(g.name, i, r) for g in R.ALL_GROUPS for i, r in enumerate(g.rules) if not r.live]


def test_table_sizes():
    sizes = {g.name: len(g.rules) for g in R.ALL_GROUPS}
    assert sizes == {"security": 50, "advanced": 14, "quality": 34, "performance": 15,
                     "maintainability": 13, "best_practice": 18}
    assert len(DEAD) == 10  # nine that need a line break and the placeholder


@pytest.mark.parametrize("group", R.ALL_GROUPS, ids=lambda g: g.name)
def test_bank_has_a_line_for_each_live_rule(group):
    for i, rule in enumerate(group.rules):
        if rule.live:
            assert any(re.search(rule.pattern, line, re.I) for line in BANK), (i, rule.pattern)


def test_dead_rules_match_no_single_line():
    for _, _, rule in DEAD:
        if rule.message:
            assert not any(re.search(rule.pattern, line, re.I) for line in BANK)


PIECES = st.lists(st.one_of(
    st.sampled_from(BANK), st.sampled_from(
        ["if ", "else ", "for ", " in ", "range(len(", "#", "//", "break", "100", "while True:", "select ",
         "+", "password", "==", "admin", "ſ", "İ", "ı", "K", "aBc = 1", "a.b", "_"]),
    st.text(max_size=6)), max_size=6).map(lambda parts: "".join(parts).replace("\n", " ").replace("\r", " "))


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_linear_form_and_literal_keep_the_verdict(line):
    folded = line.translate(str.maketrans("İıſK", "iisk")).lower()
    for name, i, rule in LIVE:
        plain = re.search(rule.pattern, line, re.I) is not None
        assert (re.search(linear_form(rule.pattern), line, re.I) is not None) == plain, (name, i, line)
        if plain:
            assert needed_literal(rule.pattern) in folded, (name, i, line)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_matching_lines_have_a_needed_text(line):
    folded = line.translate(str.maketrans("İıſK", "iisk")).lower()
    for name, i, rule in LIVE:
        if re.search(rule.pattern, line, re.I):
            texts, marked = needed_texts(rule.pattern)
            assert any(t in folded for t in texts) and (not marked or set(line) & set(MARKS)), (name, i, line)


def test_every_rule_needs_a_text():
    """Also where the pattern begins with a choice: no rule is asked of all lines."""
    assert all(all(needed_texts(rule.pattern)[0]) for _, _, rule in LIVE)
    assert needed_texts(R.QUALITY_RULES[25].pattern) == (
        ("100", "200", "404", "500", "1000", "9999"), False)
    assert needed_texts(r"if\s*(?:a|b)x*") == (("if",), False) and needed_texts("a|b") == (("",), False)


def test_scan_makes_no_row_per_line(make_files):
    """Only hits become rows; rules are asked of the lines that have a text needed by them."""
    plan = scan.own_findings(make_files([("r", "a.py", "x = 1")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1


def test_advanced_hit_that_repeats_a_security_hit(make_files):
    """E3 where both groups have a message, and a mark or a word that only prose has."""
    def group(name, *rules):
        return R.RuleGroup(name, "security", 10, (".py",), "clean", R.ONCE_PER_LINE, False, tuple(R.Rule(*r) for r in rules), skip="security")

    security = group("security", ("hush", "same", "LOW"), ("calm", "other", "LOW"))
    advanced = group("advanced", ("sh!|noise", "same", "LOW"), ("[a-c]lm", "wide", "LOW"))
    files = make_files([("r", "a.py", "so hush\nhush!\ncalm noise\nnoise\n\nno more")])
    got = sorted((r.line, r.issue) for r in scan.rule_findings(files, security, advanced).collect())
    assert got == [(1, "same"), (2, "same"), (3, "other"), (3, "same"), (4, "same")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    exts = [".py", ".js", ".java", ".php", ".rb", ".go", ".cs", ".ts", ".txt"]
    dirs = ["", "src/", ".git/", "node_modules/a/", "a/__pycache__/", "build/"]
    rows = []
    for i in range(120):
        lines = [rng.choice(BANK) + (rng.choice(BANK) if rng.random() < 0.2 else "")
                 for _ in range(rng.randrange(0, 60))]
        rows.append((f"r{i % 3}", f"{rng.choice(dirs)}f{i}{rng.choice(exts)}",
                     rng.choice(["\n", "\r\n", "\r"]).join(lines) + rng.choice(["", "\n"])))
    return rows


@pytest.mark.parametrize("group", R.ALL_GROUPS, ids=lambda g: g.name)
def test_group_equals_brute_force(make_files, corpus, group):
    got = {(r.repo_id, r.path, r.line, r.issue, r.severity)
           for r in scan.rule_findings(make_files(corpus), group).collect()}
    want = {(repo, path, *f) for repo, path, text in corpus
            for f in brute.group_findings(group, path, text)}
    assert got == want and want


def test_one_pass_equals_single_groups_and_ignores_partitioning(make_files, corpus):
    def rows(df, partitions):
        found = scan.own_findings(make_files(corpus, partitions)).drop("tool", "report_id")
        return sorted(map(repr, found.collect()))

    one = rows(None, 1)
    assert one == rows(None, 7)
    keys = [eval_key for eval_key in one]
    assert len(keys) == len(set(keys))
    found = scan.own_findings(make_files(corpus))
    for group in R.ALL_GROUPS:
        got = found.where((found["rank"] == group.rank) & (found["rule"] >= 0)).count()
        assert got == scan.rule_findings(make_files(corpus), group).count()


def test_long_line_is_matched_in_linear_time(make_files):
    """A minified line without a match at the end of the chain."""
    line = "for (i in x) if (a == b) { print(c) } " * 20_000
    rows = scan.own_findings(make_files([("r", "min.js", line)])).collect()
    assert {r.type for r in rows} >= {"performance"}


def test_repeats_at_the_ends_of_a_pattern_cost_no_power_of_the_line():
    for pattern, form in ((r"\w+.*=", r"^(?>.*?\w).*?="), (r"a+b+", "ab"), (r"\s*x.*[^c]+", r"^(?>.*?x).*?[^c]")):
        assert is_simple(pattern) and linear_form(pattern) == form
    for pattern in (r"ab+c", r"a+?b", r"a.*+b", r"\\w+b", r"x*.*a", r"(a)+", r"a{2}+"):
        assert not is_simple(pattern), pattern


def test_own_pattern_on_a_long_line(make_files):
    """Every run of words in front of a line without the last mark was tried to its end."""
    group = R.RuleGroup("mine", "quality", 20, (".py",), "raw", R.ONCE_PER_LINE, False, (R.Rule(r"\w+.*=", "m", "LOW"),))
    found = scan.rule_findings(make_files([("r", "a.py", "= " + "word " * 60_000 + "\n" + "word " * 60_000 + "\na = 1")]), group)
    assert [r.line for r in found.collect()] == [3]


PARTS = st.lists(st.sampled_from(["a", "b", "ab", r"\s", r"\.", "[ab]", "[^a]", ".*", ".*?", "|", "(a)", r"(['\"])", r"\1", "a+", "b?",
                                  "x{2}", r"\x41", r"\u0042", "^", "$", "a++", "(?i)", r"\Qa\E", r"\p{L}", r"\b", "'"]),
                 min_size=1, max_size=5).map("".join)


@settings(max_examples=600, deadline=None)
@given(PARTS, st.lists(st.text("abAB'. x\"", max_size=12), min_size=3, max_size=8))
def test_own_patterns_are_only_rewritten_if_simple(pattern, lines):
    try:
        plain = re.compile(pattern, re.I)
    except re.error:
        return
    if is_simple(pattern):
        quick, literal = re.compile(linear_form(pattern), re.I), needed_literal(pattern)
        for line in lines:
            assert bool(quick.search(line)) == bool(plain.search(line))
            assert not plain.search(line) or literal in line.lower()


def test_own_group_chooses_skip_and_mask(make_files):
    files = make_files([("r", "a.py", "# token\n\"\"\"\ntoken inside\n\"\"\"\ntoken here\nimport token")])

    def lines(**options):
        group = R.RuleGroup("mine", "quality", 20, (".py",), "raw", R.ONCE_PER_LINE, False,
                            (R.Rule("token|a.*b", "m", "LOW"),), **options)
        return sorted(r.line for r in scan.rule_findings(files, group).collect())

    assert lines() == [3, 5, 6] and lines(mask=True) == [5, 6] and lines(skip="quality") == [3, 5]


def test_tree_below_an_odd_root(spark, tmp_path):
    from siftlake.sources import corpus

    root = tmp_path / "data" / "c++" / "data"
    (root / "repoA" / "src" / "data").mkdir(parents=True)
    (root / "repoA" / "src" / "data" / "a.py").write_text("x = 1")
    (root / "repoA" / "b.md").write_text("y")
    for given in (str(root), str(root) + "/", "file://" + str(root), "file:" + str(root)):
        rows = {(r.repo_id, r.path): r.content for r in corpus.read_tree(spark, given).collect()}
        assert rows == {("repoA", "src/data/a.py"): "x = 1", ("repoA", "b.md"): "y"}
    assert [r.path for r in corpus.read_tree(spark, str(root), [".py"]).collect()] == ["src/data/a.py"]


def test_single_file_findings_equal_the_pass(make_files, corpus):
    from siftlake.operators.matching import filename_findings, line_hits, long_file_findings

    files = make_files(corpus + [("r", "a/é x.py", ""), ("r", "b c.js", "x\n" * 501), ("r", "d.js", "x\r\n" * 500 + "y"), ("r", "e.py", "x\n" * 500)])
    for alone, option in ((filename_findings, "filenames"), (long_file_findings, "long_files")):
        want = line_hits(files, **{option: True})
        got = alone(files).select([c for c in want.columns if c != "dedup"])
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.drop("dedup").collect())) and got.count() >= 2
