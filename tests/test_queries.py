"""Registered queries beside their SQL on the smallest tables.  All of them run when
SIFTLAKE_ALL is set; otherwise one per family."""

import os

import pytest

import __spark_entry__ as entry
from siftlake.workload.check import compare, connect
from tests.conftest import SF

FAMILIES = ("rules_security", "rules_best_practice", "doc_missing_function", "mask_block_comments",
            "decode_text", "prune_dirs", "size_budget", "prompt_text", "ingest_semgrep_json", "ingest_llm_json",
            "snippet_lookup", "report_matches_repo", "report_metadata_match", "union_findings", "breakdown",
            "file_scores", "scan_stats", "report_json", "report_text", "upsert_scans", "scan_store_rw",
            "recent_scans", "stream_scan_status", "scan_tree",
            "rules_own", "rule_filename", "rule_long_file", "distinct_report_paths", "tool_or_rules")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SIFTLAKE_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    from siftlake.workload.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo_id", "type", "issues"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem == ""
