"""Rules kept as a table, and groups of more rules than an expression holds."""

import random
import re
from dataclasses import replace

import pytest

from siftlake import rules as R
from siftlake.operators import matching, rule_index
from siftlake.plans import scan
from siftlake.sources.rule_tables import SCHEMA, read_rules, rule_rows
from siftlake.workload.bank import BANK

from tests import brute


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    return [(f"r{i % 2}", f"f{i}{rng.choice(['.py', '.js', '.rb', '.go'])}", "\n".join(rng.choice(BANK) for _ in range(rng.randrange(40))))
            for i in range(60)]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule_rows(spark, R.ALL_GROUPS).repartition(7).write.parquet(path)
    assert read_rules(spark.read.parquet(path)) == tuple(sorted(R.ALL_GROUPS, key=lambda g: (g.rank, g.name)))
    assert read_rules(spark.createDataFrame([], SCHEMA)) == ()


@pytest.mark.parametrize("change,reason", [
    ({"pattern": "(open"}, "(?i)pattern|regex"), ({"rank": 99}, "differ"), ({"ordinal": 1}, "twice"), ({"text": "upper"}, "not one of"),
    ({"pattern": None}, "null"), ({"group_name": "a b"}, "letters"), ({"mask": None}, "null")])
def test_tables_that_are_refused(spark, change, reason):
    group = replace(R.PERFORMANCE, rules=R.PERFORMANCE.rules[:2])
    table = [r.asDict() for r in rule_rows(spark, [group]).collect()]
    for row in table if set(change) & {"text", "group_name", "mask"} else table[:1]:
        row.update(change)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    with pytest.raises(Exception, match=reason):
        read_rules(spark.createDataFrame([tuple(r[n] for n in names) for r in table], SCHEMA))


@pytest.mark.parametrize("group", R.ALL_GROUPS, ids=lambda g: g.name)
def test_wide_groups_find_the_same(make_files, monkeypatch, rows, group):
    """Every built-in group through the index of literals, against brute force."""
    monkeypatch.setattr(matching, "WIDE", 0)
    got = {(r.repo_id, r.path, r.line, r.issue, r.severity) for r in scan.rule_findings(make_files(rows), group).collect()}
    want = {(repo, path, *f) for repo, path, text in rows for f in brute.group_findings(group, path, text)}
    assert got == want and want


def test_two_thousand_rules(make_files):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(3_000)})[:2_000]
    rng.shuffle(words)
    rules = tuple(R.Rule(rng.choice(["{}", r"{}\s*=", "x.*{}", "({})"]).format(w), f"m{i % 50}", "LOW") for i, w in enumerate(words))
    for dedup in (R.ONCE_PER_LINE, R.FIRST_PER_MESSAGE):
        group = R.RuleGroup("many", "quality", 20, (".py",), "raw", dedup, False, rules)
        text = [" ".join(rng.choice(words + ["x", "=", "zz"]) for _ in range(rng.randint(0, 3))) for _ in range(120)]
        got = {(r.line, r.issue) for r in scan.rule_findings(make_files([("r", "a.py", "\n".join(text))]), group).collect()}
        want, seen = set(), set()
        for n, line in enumerate(text, 1):
            first = next((r.message for r in rules if line.strip() and re.search(r.pattern, line, re.I)), None)
            if first and (dedup == R.ONCE_PER_LINE or first not in seen):
                want.add((n, first))
                seen.add(first)
        assert got == want and len(want) > 20


def test_gates_cover_their_literals():
    rng = random.Random(2)
    literals = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(500)]
    found = rule_index.gates(literals)
    assert sorted(i for own in found.values() for i in own) == list(range(500))
    assert all(gate in literals[i] for gate, own in found.items() for i in own)
    assert len(found) < 150


def test_first_per_message_needs_no_shuffle(make_files, rows):
    found = scan.rule_findings(make_files(rows), R.PERFORMANCE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortAggregate" not in plan


def test_word_rules_are_settled_by_their_literal(make_files):
    """A pattern in a row is compiled for every line; a word needs none, unless its text lacks the comments."""
    words = [f"word{i}" for i in range(matching.WIDE)] + ["token", r"tok\w+x", "to ken"]
    files = make_files([("r", "a.py", "x\n a TOKEN  # word7\n word3word5\nto ken\ntokenax\nwo rd9\n" + "word11 " * 2_000)])
    for text, extra in (("raw", {7}), ("stripped", {7}), ("clean", set())):
        group = R.RuleGroup("many", "quality", 20, (".py",), text, R.ONCE_PER_LINE, False, tuple(R.Rule(w, w, "LOW") for w in words))
        settled = {r["rule"] for gate in rule_index.index(group) for r in gate["rules"] if r["pattern"] is None}
        assert settled == (set() if text == "clean" else set(range(matching.WIDE + 1)))
        found = scan.rule_findings(files, group)
        want = {(2, "word7" if extra else "token"), (3, "word3"), (4, "to ken"), (5, "token"), (7, "word1")}
        assert {(r.line, r.issue) for r in found.collect()} == want, text
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_join(texts") == 1  # not again for every gate and rule
