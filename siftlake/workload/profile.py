"""Where the time of the one-pass scan goes: python -m siftlake.workload.profile [sf_dir]

Best of three runs each, on local[8], the files of the workload written into 16 parts before."""

from __future__ import annotations

import random
import sys
import time

from pyspark.sql import functions as F

from siftlake import rules as R
from siftlake.functions import text as T
from siftlake.operators.lines import annotated_lines
from siftlake.operators.matching import line_hits, prepared_lines, reads
from siftlake.plans import scan
from siftlake.session import cut, local_session
from siftlake.workload import tables


def trie(words) -> str:
    """One alternation of all words, common beginnings taken together."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:  # the shortest decides
            return ""
        parts = [f"\\Q{ch}\\E" + pattern(rest) for ch, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return pattern(root)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session("8", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(16, "doc_id")
    files = cut(tables.as_files(docs), "files")
    literals = sorted({T.needed_literal(r.pattern) for g in R.ALL_GROUPS for r in g.rules if r.live} - {""})
    low = files.withColumn("low", F.lower("content"))
    carry = {f"reads_{g.name}": reads(g) for g in R.ALL_GROUPS}
    lines = annotated_lines(files, carry=carry)
    prepared = prepared_lines(lines)
    words = [r["w"] for r in docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 6")
             .groupBy("w").count().orderBy(F.desc("count"), "w").limit(20_000).collect()]
    random.Random(0).shuffle(words)
    many = R.RuleGroup("many", "quality", 20, R.SECURITY_EXTENSIONS, "raw", R.FIRST_PER_MESSAGE, False,
                       tuple(R.Rule(w, f"Word {w}", "LOW") for w in words[:2_000]))

    def tests(text: str) -> list:
        return [F.expr(f"contains({text}, {T.sql_text(x)})") for x in literals]

    steps = {
        "files, lower case": low.select(F.length("low")),
        f"{len(literals)} literals, each looked for in the file": low.select(*tests("low")),
        "the same as one alternation": low.select(F.regexp_count("low", F.lit(trie(literals)))),
        "lines with their state": lines,
        "lines prepared": prepared,
        "lines prepared, each literal looked for": prepared.select(*tests("low")),
        "hits of the six groups": line_hits(files, R.ALL_GROUPS),
        "the whole scan": scan.own_findings(files),
        "rules_performance": scan.rule_findings(files, R.PERFORMANCE),
        "docstrings and marks": scan.documentation_findings(files),
        "a group of 2 000 rules": scan.rule_findings(files, many),
    }
    for name, df in steps.items():
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        print(f"{name} | {best:.2f}", flush=True)


if __name__ == "__main__":
    main()
