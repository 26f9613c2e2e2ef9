"""Rule groups kept as a table, so that rules are edited without a change of code.

One row per rule: group_name, rank, issue_type, extensions, text, dedup, prune, skip, mask (the same in
all rows of a group), ordinal, pattern, message (null: a placeholder that never matches), severity.
A rule table is configuration: up to MOST_RULES rows come to the driver, more are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlake import rules as R

MOST_RULES = 20_000
SCHEMA = ("group_name string, rank int, issue_type string, extensions array<string>, text string, dedup string, prune boolean, "
          "skip string, mask boolean, ordinal int, pattern string, message string, severity string")
_GROUP = ("rank", "issue_type", "extensions", "text", "dedup", "prune", "skip", "mask")
_ALLOWED = {"text": ("raw", "stripped", "clean"), "dedup": (R.ONCE_PER_LINE, R.FIRST_PER_MESSAGE),
            "skip": ("simple", "security", "quality")}


def rule_rows(spark: SparkSession, groups) -> DataFrame:
    """The table of the given groups."""
    return spark.createDataFrame([
        (g.name, g.rank, g.issue_type, list(g.extensions), g.text, g.dedup, g.prune, g.skip, g.mask, i, r.pattern, r.message, r.severity)
        for g in groups for i, r in enumerate(g.rules)], SCHEMA)


def read_rules(table: DataFrame) -> tuple[R.RuleGroup, ...]:
    """The groups of a rule table by rank and name, their rules by ordinal.  A table that contradicts
    itself, or has a pattern that is no regular expression, is refused with the reason."""
    named = [c.split()[0] for c in SCHEMA.split(", ")]
    # every pattern is compiled once by Spark itself, whose dialect counts
    rows = table.select(*named, F.rlike(F.lit(""), F.col("pattern")).alias("compiled")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table may have {MOST_RULES} rows")
    groups: dict[str, dict] = {}
    for row in rows:
        if row["group_name"] is None or row["ordinal"] is None or row["pattern"] is None:
            raise ValueError("group_name, ordinal and pattern may not be null")
        facts = tuple(tuple(row[c]) if isinstance(row[c], list) else row[c] for c in _GROUP)
        one = groups.setdefault(row["group_name"], {"facts": facts, "rules": {}})
        if one["facts"] != facts:
            raise ValueError(f"group {row['group_name']}: {', '.join(_GROUP)} differ between its rules")
        if row["ordinal"] in one["rules"]:
            raise ValueError(f"group {row['group_name']}: ordinal {row['ordinal']} occurs twice")
        one["rules"][row["ordinal"]] = R.Rule(row["pattern"], row["message"], row["severity"])
    out = []
    for name, one in groups.items():
        facts = dict(zip(_GROUP, one["facts"]))
        for field, allowed in _ALLOWED.items():
            if facts[field] not in allowed:
                raise ValueError(f"group {name}: {field} is {facts[field]!r}, not one of {', '.join(allowed)}")
        if None in (facts["rank"], facts["issue_type"], facts["extensions"], facts["prune"], facts["mask"]):
            raise ValueError(f"group {name}: {', '.join(_GROUP)} may not be null")
        if not name.isidentifier():
            raise ValueError(f"group {name!r}: a name has letters, digits and underscores")
        rules = tuple(one["rules"][k] for k in sorted(one["rules"]))
        out.append(R.RuleGroup(name, facts["issue_type"], facts["rank"], facts["extensions"], facts["text"], facts["dedup"],
                               facts["prune"], rules, facts["skip"], facts["mask"]))
    return tuple(sorted(out, key=lambda g: (g.rank, g.name)))
