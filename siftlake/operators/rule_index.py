"""Groups of very many rules: from the literals that rules need to the rules that may match.

A group of thousands of rules is no expression but a value: an array of gates, each with its rules.  A
gate is a short text that the needed literals of its rules have in common, so most rules of a file
fall away with one look for their gate in its whole text.  The rules that are left, usually few, are
looked for in each line by their literal, and only then by their pattern.  Rules that need no literal
stand behind a gate that is always open."""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import Column, functions as F

from siftlake import rules as R
from siftlake.functions import text as T

GATE = 4  # letters of a gate
# A pattern that its literal settles: letters that no trimming takes, so the folded line has them where the
# matched text has them, unless that lacks the comments.  A pattern in a row is compiled anew for each line.
_WORD = re.compile(r"[A-Za-z0-9_]+")
_INDEX = "array<struct<gate:string,rules:array<struct<rule:int,literal:string,pattern:string>>>>"


def gates(literals: list[str]) -> dict[str, list[int]]:
    """For each gate the positions of its literals.  A literal goes to that of its runs of GATE
    letters which most literals have; a shorter one is its own gate, and '' is always open."""
    runs = [{x[i:i + GATE] for i in range(len(x) - GATE + 1)} or {x} for x in literals]
    often: dict[str, int] = defaultdict(int)
    for own in runs:
        for run in own:
            often[run] += 1
    out: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(runs):
        out[min(own, key=lambda run: (-often[run], run))].append(i)
    return dict(out)


def index(group: R.RuleGroup) -> list[dict]:
    """The gates of a group's live rules."""
    live = [(i, r.pattern) for i, r in enumerate(group.rules) if r.live]
    quick = [p in R.BUILT_IN or T.is_simple(p) for _, p in live]
    literals = [T.needed_literal(p) if q else "" for (_, p), q in zip(live, quick)]

    def pattern(k: int) -> str | None:
        if group.text != "clean" and _WORD.fullmatch(live[k][1]):
            return None
        return T.FLAGS + (T.linear_form(live[k][1]) if quick[k] else live[k][1])

    return [{"gate": gate, "rules": [{"rule": live[k][0], "literal": literals[k], "pattern": pattern(k)} for k in own]}
            for gate, own in sorted(gates(literals).items())]


def words(low: Column) -> Column:
    """Each run of word letters of a text once: shorter than the text, which says most words again and again."""
    return F.array_join(F.array_distinct(F.split(low, "[^a-z0-9_]+")), " ")


def candidates(group: R.RuleGroup, low: Column, runs: Column) -> Column:
    """The rules whose literals occur in ``low``, the folded text of a file, in their order.  Literals
    of word letters are looked for in ``runs``, its :func:`words`."""
    def near(table: list[dict], text: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.from_json(F.lit(json.dumps(table)), _INDEX), lambda g: F.contains(text, g.gate)),
                                     lambda g: F.filter(g.rules, lambda r: F.contains(text, r.literal))))

    plain, other = [], []
    for gate in index(group):
        own = [r for r in gate["rules"] if _WORD.fullmatch(r["literal"])]
        rest = [r for r in gate["rules"] if not _WORD.fullmatch(r["literal"])]
        plain += [{**gate, "rules": own}] if own else []
        other += [{**gate, "rules": rest}] if rest else []
    return F.array_sort(F.concat(near(plain, runs), near(other, low)))


def candidate_match(column: str, text: str, low: str) -> str:
    """SQL text: the first of a file's candidates that matches a line, or null."""
    return (f"get(filter({column}, r -> contains({low}, r.literal) AND "
            f"(r.pattern IS NULL OR rlike({text}, r.pattern))), 0).rule")
