"""The versioned scan table against a plain dictionary."""

import glob
import random

import pytest

from siftlake.operators.scan_table import ScanTable

KIND = ("job_id string, user_id int, repo_url string, status string, total_issues int, created_at timestamp_ntz, "
        "updated_at timestamp_ntz")


def _row(job, user, status, n):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1) + timedelta(minutes=n)
    return (job, user, f"u{n}", status, n, at, at)


def _state(df):
    return {r.job_id: tuple(r) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return ScanTable(spark, str(tmp_path / "scans"), spark.createDataFrame([], KIND).schema, parts=6)


def test_many_changes(spark, table):
    rng, want, kept = random.Random(8), {}, {}
    for n in range(8):
        rows = [_row(f"j{rng.randrange(12)}", rng.choice([1, 2, None]), rng.choice(["running", "failed"]), 20 * n + k) for k in range(4)]
        rows = list({r[0]: r for r in rows}.values())
        kind = rng.choice(["upsert", "upsert", "delete", "clear"])
        if kind == "upsert":
            version = table.upsert(spark.createDataFrame(rows, KIND))
            for r in rows:
                old = want.get(r[0])
                want[r[0]] = r if old is None else (r[0], old[1], old[2], r[3], r[4], old[5], r[6])
        elif kind == "delete":
            version = table.delete(spark.createDataFrame([(r[0], 1) for r in rows], "job_id string, user_id int"))
            want = {j: r for j, r in want.items() if not (r[1] == 1 and j in {x[0] for x in rows})}
        else:
            version = table.clear(2)
            want = {j: r for j, r in want.items() if r[1] != 2}
        kept[version] = dict(want)
        assert _state(table.read()) == want
    for version, state in kept.items():  # all older versions are still there
        if version:
            assert _state(table.read(version)) == state


def test_one_job_rewrites_one_part(spark, table, tmp_path):
    table.upsert(spark.createDataFrame([_row(f"j{i}", 1, "queued", i) for i in range(60)], KIND))
    before, reader = table._manifest(None)[1], table.read()
    assert len(before) == 6
    assert table.upsert(spark.createDataFrame([_row("j7", 1, "completed", 99)], KIND)) == 2
    after = table._manifest(None)[1]
    assert sum(before[p] != after[p] for p in before) == 1
    new = {f for f in after.values()} - set(before.values())
    assert len(glob.glob(f"{tmp_path}/scans/data/{new.pop()}/part=*")) == 1
    old = _state(reader)
    assert old["j7"][3] == "queued" and _state(table.read())["j7"][3] == "completed"


def test_nothing_empties_and_conflicts(spark, table):
    empty = spark.createDataFrame([], KIND)
    assert table.versions() == [] and table.upsert(empty) == 0 and _state(table.read()) == {} and table.clear(1) == 0
    table.upsert(spark.createDataFrame([_row("a", 1, "queued", 1)], KIND))
    assert table.clear(1) == 2 and _state(table.read()) == {} and table.versions() == [1, 2]
    assert _state(table.read(1)) != {}
    with pytest.raises(ValueError, match="version 9"):
        table.read(9)
    with pytest.raises(Exception, match="(?i)exists"):  # another writer made this version
        table._commit(2, {})
    assert table.upsert(spark.createDataFrame([_row("a", 1, "running", 2)], KIND)) == 3
