"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlake.session import local_session  # noqa: E402
from siftlake.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "gate_by_language",  # the whole one-pass scan
    "rules_security",
    "rules_performance",
    "mask_block_comments",
    "union_findings",
    "breakdown",
    "scores",
    "top_files",
    "snippet_lookup",
    "size_budget",
    "report_matches_repo",
    "report_json",
    "report_text",
    "upsert_scans",
    "recent_scans",
)


def laid_out(spark, sf_dir: str, parts: int) -> str:
    """The tables with their documents in ``parts`` files, as a lake keeps them.  The given file is
    one row group, which Spark can only read in one task.  Not part of the times."""
    top = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(sf_dir, name), os.path.join(top, name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(parts, "doc_id").write.parquet(f"{top}/documents.parquet")
    return top


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start of the JVM is not a query's
    names = sys.argv[1:] or HEADLINE
    data = laid_out(spark, sf_dir, 2 * (int(cpus) if cpus.isdigit() else 8))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
