import datetime as dt
import json
import random

from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import history as H
from siftlake.sources import test_reports as TR, tool_reports as TO
from siftlake.streaming import jobs

REPORT = "repo_id string, report_id long, report string"


def responses(spark, texts):
    return spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], REPORT)


def test_model_text_forms(spark):
    issue = '{"issues": [{"file": "a.py", "line": "3", "type": "quality", "severity": "LOW", "issue": "t"}]}'
    rows = TO.ingest_model(responses(spark, [
        f"Sure: {issue} bye", f"{issue} and more }}", '{"other": 1}', "no json\nA slow loop", "} {", "} security {",
    ])).collect()
    got = [(r.report_id, r.path, r.line, r.type, r.severity) for r in rows]
    assert got[0] == (0, "a.py", 3, "quality", "LOW")
    # text after the object makes it invalid: read as prose
    assert (1, "detected_file", 1, "quality", "MEDIUM") in got
    assert [g for g in got if g[0] in (2, 4)] == []
    assert [g for g in got if g[0] == 3] == [(3, "detected_file", 1, "performance", "MEDIUM")]
    assert [g for g in got if g[0] == 5] == [(5, "detected_file", 1, "security", "HIGH")]


def test_prose_cap_and_clip(spark):
    prose = responses(spark, ["\n".join(["  an issue " + "x" * 200] * 30)])
    rows = TO.ingest_model(prose).collect()
    assert len(rows) == 30 and all(len(r.issue) == 100 and r.issue.startswith("an issue") for r in rows)
    assert prose.select(F.size(TO.prose_findings(F.col("report"), 20))).first()[0] == 20


def test_snippets_of_many_findings_in_one_large_file(spark, make_files):
    lines = [f"line {i} " + "x" * 100 for i in range(1, 20_001)]
    files = make_files([("r", "big.py", "\n".join(lines))])
    rows = spark.range(10_000).select(F.lit("r").alias("repo_id"), F.lit("big.py").alias("path"),
                                      (F.col("id") * 2 + 1).cast("int").alias("line"), F.lit("pylint").alias("tool"))
    found = TO.snippet_lookup(rows, files)
    assert found.where(F.col("code_snippet") != F.concat(F.lit("line "), "line", F.lit(" " + "x" * 100))).count() == 0
    assert found.count() == 10_000
    plan = found._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan


def test_snippets(spark, make_files):
    files = make_files([("r", "a/b.py", "one\r\n two \nthree")])
    rows = spark.createDataFrame([("r", "/a/b.py", 2), ("r", "a/b.py", 1), ("r", "a/b.py", 9), ("r", "a/b.py", 0),
                                  ("q", "a/b.py", 1)], "repo_id string, path string, line int"
                                 ).withColumn("tool", F.lit("pylint"))
    got = {(r.repo_id, r.path, r.line): r.code_snippet for r in TO.snippet_lookup(rows, files).collect()}
    assert got == {("r", "/a/b.py", 2): "two", ("r", "a/b.py", 1): "one", ("r", "a/b.py", 9): "",
                   ("r", "a/b.py", 0): "", ("q", "a/b.py", 1): ""}


def test_snippets_of_prose(spark, make_files):
    """Prose names one file for all findings: few repositories have it."""
    files = make_files([("r", "detected_file", " first \nsecond"), ("q", "a.py", "x")])
    rows = spark.createDataFrame([(repo, TO.PROSE_FILE, 1, given) for repo in ("r", "q", None) for given in (None, "own")],
                                 "repo_id string, path string, line int, code_snippet string").withColumn("tool", F.lit("model"))
    for some, text in ((files, "first"), (files.where("repo_id = 'q'"), "")):
        got = sorted(map(str, ((r.repo_id, r.code_snippet) for r in TO.snippet_lookup(rows, some).collect())))
        assert got == sorted(map(str, [("r", text), ("r", "own"), ("q", ""), ("q", "own"), (None, ""), (None, "own")]))


KEYS = ["file", "filename", "FilePath", "path", "source_file", "test_file", "name", "x\"file", "files"]


def random_json(rng, depth=0):
    kind = rng.randrange(6)
    if depth > 4 or kind == 0:
        return rng.choice(["a.py", 'q"u\\o', '"file": "no.py"', "é/ß.py", "", "x\ny", 3, None, True])
    if kind < 4:
        return {rng.choice(KEYS): random_json(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]


def walk(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in TR.PATH_KEYS and isinstance(v, str):
                yield v
            yield from walk(v)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v)


def test_paths_at_any_depth(spark):
    rng = random.Random(11)
    docs = [{"top": random_json(rng), rng.choice(KEYS): random_json(rng)} for _ in range(300)]
    rows = [("r", i, json.dumps(d, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5))
            for i, d in enumerate(docs)]
    got = {(r.report_id, r.path) for r in TR.report_paths(spark.createDataFrame(rows, REPORT)).collect()}
    assert got == {(i, p) for i, d in enumerate(docs) for p in walk(d)}


def test_long_and_much_escaped_values(spark):
    values = ["x" * 1_000_000, 'a\\"' * 100_000 + ".py", "é" * 50_000]
    rows = [("r", i, json.dumps({"file": v})) for i, v in enumerate(values)]
    got = {r.report_id: r.path for r in TR.report_paths(spark.createDataFrame(rows, REPORT)).collect()}
    assert got == dict(enumerate(values))


def test_match_threshold(spark, make_files):
    files = make_files([("r", "src/a.py", ""), ("r", "main.py", "")])

    def report(*paths):
        return json.dumps({"tests": [{"file": p} for p in paths]})

    cases = [report("src/a.py"), report("no1", "no2"), report("no1", "no2", "no3"), report("./src/a.py", "n1", "n2"),
             report("src/a.py", "n1", "n2", "n3"), report("deep/main.py", "src/"), "{}", report(" ../src", "/main.py")]
    rows = spark.createDataFrame([("r", i, "u", c) for i, c in enumerate(cases)],
                                 "repo_id string, report_id long, repo_url string, report string")
    got = {r.report_id: (r.files_found, r.total_files, r.matches) for r in TR.report_match(rows, files).collect()}
    assert got == {0: (1, 1, True), 1: (0, 2, True), 2: (0, 3, False), 3: (1, 3, True), 4: (1, 4, False),
                   5: (2, 2, True), 6: (0, 0, True), 7: (2, 2, True)}
    message = TR.report_match(rows, files).where("report_id = 2").first().message
    assert message.endswith("Only 0/3 test files found in repository. Missing files: no1, no2, no3...")


def test_metadata(spark):
    def match(doc, url="https://h/own/tool.git"):
        df = spark.createDataFrame([("r", 1, url, json.dumps(doc))],
                                   "repo_id string, report_id long, repo_url string, report string")
        r = TR.report_metadata_match(df).first()
        return r.metadata_matches

    assert match({"Repository": "x/TOOL"}) and match({"metadata": {"metadata": {"repo": "tool"}}})
    assert match({"name": "my tool"}) and not match({"name": "test_tool"})
    assert match({"metadata": {"name": "tool"}}) and not match({"metadata": {"metadata": {"name": "tool"}}})
    assert not match({"metadata": {"metadata": {"metadata": {"metadata": {"repo": "tool"}}}}})
    assert not match({"results": {"repo": "tool"}}) and not match({})
    assert match({"coverage": {"files": [{"path": "a"}, {"path": "src/tool/x"}]}})
    assert not match({"coverage": {"files": [{"path": "src/tool/x"}, {"path": "a"}]}})
    # of equal keys the later one in the document counts, whatever its depth
    assert match({"metadata": {"repo": "other"}, "repo": "tool"}) and not match({"metadata": {"repo": "tool"}, "repo": "other"})
    assert match({"repo": "other", "metadata": {"repo": "tool"}}) and not match({"repo": "tool", "Metadata": {"repo": "other"}})
    assert match({"metadata": {"a": 1}, "Metadata": {"repo": "tool"}}) and not match({"metadata": "repo tool"})


def test_addresses(spark):
    cases = {
        "https://github.com/Own/Repo.git": ("repo", "own", "repo"), "git@github.com:o/r.git/": ("r", "o", "r"),
        "plain": ("plain", "", "plain"), "git@h:solo": ("solo", "", "solo"), " http://h/a/b/c/ ": ("c", "b", "c"),
        "x/y.git.git": ("y.git", "", "y.git")}
    url = F.col("u")
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select(
        "u", T.repo_name(url).alias("n"), T.owner_name(url).alias("o"), T.owned_repo_name(url).alias("r"))
    assert {r.u: (r.n, r.o, r.r) for r in rows.collect()} == cases
    valid = spark.createDataFrame([("123456789",), (" 1234567890 ",), (None,)], "u string").select(T.valid_repo_url(url))
    assert [r[0] for r in valid.collect()] == [False, True, False]


SCAN = ("job_id string, user_id int, repo_url string, status string, total_issues int, security_issues int, "
        "quality_issues int, files_scanned int, directories_scanned int, "
        "issues array<struct<issue:string>>, unit_test_report struct<passed:int>, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz")
EVENT = SCAN + ", event_id long"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def write(job, minute, status="running", user=1, n=0, issues=None):
    return (job, user, f"u{user}", status, n, n, n, n, n, issues, None, at(minute), at(minute),
            at(minute) if status == "completed" else None)


def fold(writes):
    jobs_ = {}
    for w in sorted(writes, key=lambda w: w[12]):
        old = jobs_.get(w[0])
        jobs_[w[0]] = w if old is None else (w[0], *old[1:3], *w[3:11], old[11], *w[12:])
    return jobs_


def test_upsert(spark):
    base = [write("a", 1, n=1), write("b", 2, "completed", n=2)]
    new = [write("a", 5, "completed", user=9, n=5), write("c", 3, "queued", user=None), write("c", 4, user=7, n=4)]
    got = H.upsert_scans(spark.createDataFrame(base, SCAN), spark.createDataFrame(new, SCAN))
    assert {r.job_id: tuple(r) for r in got.select(*[c.split()[0] for c in SCAN.replace("array<struct<issue:string>>", "x").replace("struct<passed:int>", "x").split(", ")]).collect()} == fold(base + new)


def test_history_views(spark):
    rows = [write(f"j{i}", i % 60, user=[None, 1, 2][i % 3]) for i in range(200)]
    scans = spark.createDataFrame(rows, SCAN)
    assert H.recent_scans(scans, 1).count() == 50
    top = H.recent_scans_by_owner(scans).where("user_id = 1").orderBy("place").collect()
    assert [r.created_at for r in top] == sorted((r.created_at for r in top), reverse=True) and len(top) == 50
    assert H.get_scan(scans, "j1", 2).count() == 0 and H.get_scan(scans, "j1", 0).count() == 1
    assert H.visible_scans(scans, None).where("user_id IS NOT NULL").count() == 0
    assert H.visible_scans(scans, 2).select("user_id").distinct().count() == 2
    assert H.clear_scans(scans, 1).count() == 200 - 67
    doomed = spark.createDataFrame([("j1", 1), ("j2", 1)], "job_id string, user_id int")
    assert H.delete_scan(scans, doomed).count() == 199


def test_store_round_trip(spark):
    rows = [write("a", 1, issues=[("x",), (None,)]), write("b", 2, issues=[]), write("c", 3)]
    back = {r.job_id: r for r in H.scan_store_rw(spark.createDataFrame(rows, SCAN)).collect()}
    assert [i.issue for i in back["a"].issues] == ["x", None]
    assert back["b"].issues == [] and back["c"].issues == [] and back["c"].unit_test_report is None


def test_duration(spark):
    row = spark.createDataFrame([(at(1), at(2) + dt.timedelta(microseconds=345678))], "a timestamp_ntz, b timestamp_ntz")
    seconds, text = H.scan_duration(F.col("a"), F.col("b"))
    r = row.select(seconds.alias("s"), text.alias("t")).first()
    assert r.s == 60.345678 and r.t == "60.35s"


def test_status_stream_over_many_batches(spark, tmp_path):
    """Batches in any order, one of them twice, give the fold of all writes."""
    rng = random.Random(4)
    writes = [write(f"j{rng.randrange(5)}", m, rng.choice(["queued", "running", "completed", "failed"]),
                    user=rng.randrange(1, 4), n=m) for m in range(60)]
    rng.shuffle(writes)
    events = [(*w, i) for i, w in enumerate(writes)]
    for i in range(0, 60, 15):
        spark.createDataFrame(events[i:i + 15], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(events[:15], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], EVENT).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_scan_status(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    names = [f.name for f in schema][:-1]
    assert {r.job_id: tuple(r) for r in out.select(names).collect()} == fold(writes)
    # compacted, the past gives the same table, also beside what came twice
    jobs.compact_status(spark, str(tmp_path / "packed"), str(tmp_path / "out"))
    for folders in ([tmp_path / "packed"], [tmp_path / "packed", tmp_path / "out"]):
        again = jobs.status_table(spark, *map(str, folders))
        assert {r.job_id: tuple(r) for r in again.select(names).collect()} == fold(writes)


def test_status_stream_with_state(spark, tmp_path):
    """Batches in any order, one of them twice, and a restart from the checkpoint in between."""
    from siftlake.operators.scan_table import ScanTable

    rng = random.Random(14)
    writes = [write(f"j{rng.randrange(5)}", m, rng.choice(["queued", "running", "completed", "failed"]),
                    user=rng.randrange(1, 4), n=m) for m in range(60)]
    rng.shuffle(writes)
    events = [(*w, i) for i, w in enumerate(writes)]
    schema = spark.createDataFrame([], EVENT).schema
    table = ScanTable(spark, str(tmp_path / "table"), schema[:-1], parts=3)
    seen = []
    for part in (events[:15], events[15:30], events[:15], events[30:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen += part
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = jobs.stream_scan_table(stream, table, str(tmp_path / "state"))
        assert {r.job_id: tuple(r) for r in out.collect()} == fold([e[:-1] for e in sorted(set(seen), key=lambda e: e[-1])])
    assert len(table.versions()) == 4


def test_events_of_equal_time_follow_state_and_event(spark, tmp_path):
    """Whatever batch they come in."""
    rng = random.Random(12)
    events = [(*write(f"j{i % 3}", 7, ["completed", "queued", "running", "failed"][i % 4], n=i), i) for i in range(24)]
    want = {}
    for e in sorted(events, key=lambda e: (H.STATES[e[3]], e[-1])):
        want[e[0]] = e[-1]
    for run in range(3):
        rng.shuffle(events)
        for i in range(0, 24, 8):
            spark.createDataFrame(events[i:i + 8], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{run}"))
        stream = (spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1)
                  .parquet(str(tmp_path / f"in{run}")))
        out = jobs.stream_scan_status(stream, str(tmp_path / f"out{run}"), str(tmp_path / f"state{run}"))
        assert {r.job_id: r.total_issues for r in out.collect()} == want


def test_findings_stream_equals_batch(spark, tmp_path, make_files):
    from siftlake.operators.findings import gate_by_language, repo_gates, with_fix
    from siftlake.plans.scan import own_findings

    rows = [("r" if i < 4 else "s", f"f{i}.{'py' if i in (1, 3) else 'js'}", "eval(x)\ndef a():\ndef b():\n" * (i + 1))
            for i in range(6)]
    for i in range(0, 6, 2):
        make_files(rows[i:i + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = make_files(rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.stream_findings(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    files = make_files(rows)
    want = with_fix(gate_by_language(own_findings(files), repo_gates(files)))
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_streams_read_a_file_and_a_folder_of_parts(spark, tmp_path, make_files):
    rows = make_files([("r", f"f{i}.py", "eval(x)\n") for i in range(6)])
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "files.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "files.parquet")
    for kind in ("parts", "file"):
        stream = jobs.read_stream(spark, str(tmp_path / kind), "files.parquet", rows.schema)
        got = jobs.stream_findings(stream, str(tmp_path / f"out_{kind}"), str(tmp_path / f"state_{kind}"))
        assert sorted(r.path for r in got.where("type = 'security'").collect()) == [f"f{i}.py" for i in range(6)], kind


def test_a_stream_without_files_has_no_findings(spark, tmp_path, make_files):
    rows = make_files([("r", "a.py", "eval(x)\n")])
    (tmp_path / "in" / "files.parquet").mkdir(parents=True)
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "files.parquet", rows.schema)
    got = jobs.stream_findings(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.collect() == [] and {"repo_id", "path", "line", "minimal_fix"} <= set(got.columns)


def test_changed_files_replace_their_findings(spark, tmp_path, make_files):
    """A file sent twice, one sent changed, one emptied, one twice in a batch: as the last state in one batch."""
    from siftlake.operators.findings import gate_by_language, repo_gates, with_fix
    from siftlake.plans.scan import own_findings

    code, more = "eval(x)\ndef a():\ndef b():\n", "password = 'abc'\nimport os\n"
    batches = [[("r", "a.py", code), ("r", "b.js", code), (None, "c.py", code), ("s", "only.py", more)],
               [("r", "a.py", code), ("r", "b.js", more)],
               [("s", "only.py", None), ("r", "d.py", more), ("r", "d.py", more)],
               [(None, "c.py", more), ("t", "e.py", code)], [(None, "c.py", code)]]
    for n, rows in enumerate(batches):
        make_files(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(make_files(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = jobs.stream_findings(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        state = {}
        for some in batches[:n + 1]:
            state.update({r[:2]: r for r in some})
        files = make_files(list(state.values()))
        want = with_fix(gate_by_language(own_findings(files), repo_gates(files)))
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    scanned = spark.read.parquet(str(tmp_path / "out" / "files")).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in scanned} == {0: 4, 1: 1, 2: 2, 3: 2, 4: 1}  # a.py was not scanned again


def test_paths_however_they_are_written(spark):
    deep = '{"path": "deep.py"}'
    for i in range(60):
        deep = f'{{"a": [{deep}]}}' if i % 2 else f'[{{"b{i}": {deep}}}]'
    bodies = ['{"\\u0066ile": "a.py"}', '{"FI\\u004cE": "\\u0061\\/b.py"}', deep, '{"file": "x", "file": "y"}', '{"file": "x"', "",
              '{"a": "{\\"file\\": \\"text.py\\"}"}', '{"file": 3, "path": null, "a": {"path": true, "filename": ""}}',
              '[1, {"file": "z"}]', '"file"', '{"file": {"file": ["f", {"file": "in.py"}]}}']
    rows = spark.createDataFrame([("r", i, b) for i, b in enumerate(bodies)], "repo_id string, report_id long, report string")
    got = sorted((r.report_id, r.path) for r in TR.report_paths(rows).collect())
    assert got == [(0, "a.py"), (1, "a/b.py"), (2, "deep.py"), (3, "y"), (7, ""), (8, "z"), (10, "in.py")]
    assert TR.report_paths(rows.limit(0)).collect() == []
