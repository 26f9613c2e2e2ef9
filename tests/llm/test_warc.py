"""WARC archives: round trip, the standard library's ZIP reader, odd rows."""

import glob
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

import __spark_entry__ as entry
from siftlake.llm import warc
from siftlake.session import fresh_path
from siftlake.workload.check import compare, connect
from tests.conftest import SF

KIND = "page_id long, url string, html string"
LONG = "<p>same words, more than a hundred bytes</p>" * 4
ROWS = [(5, "http://a.b/x", LONG), (3, "http://a.b/y", LONG), (9, None, LONG), (3, "http://a.b/y", LONG), (1, "u\r\nX: 1 é", "short"),
        (2, "", "short"), (4, "http://[bad/", None), (6, "http://a.b/z", ""), (None, "n", LONG), (None, "n", "PK\x05\x06\r\n\r\nWARC/1.1" * 20),
        (7, "http://a.b/é?q= 1", "漢字 🙂\n\n\r\n" * 50), (8, "http://long/", "x" * 3_000_000)]


def _expected(rows):
    first = {}
    for i, _, html in rows:
        key = (html or "").encode()
        if len(key) >= 100 and i is not None:
            first[key] = min(i, first.get(key, i))
    out = []
    for i, _, html in rows:
        key = (html or "").encode()
        again = first.get(key) is not None and first[key] != i
        out.append((i, len(key), hashlib.sha256(key).hexdigest(), "revisit" if again else "response", first[key] if again else None))
    return sorted(out, key=str)


def _read(spark, path):
    return sorted(((r[0], r[1], r[2], r[3], r[4]) for r in warc.read(spark, path).select(
        warc.page_of("record_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to")).collect()), key=str)


def _archives(path):
    return [f for f in glob.glob(path.removeprefix("file:") + "/part-*") if open(f, "rb").read(1)]


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op12_warc"](spark, SF), connect(SF), entry.oracle_sql()["op12_warc"]) == ""


@pytest.mark.parametrize("compress,zip64", [(True, False), (False, True), (True, True)])
def test_round_trip_of_odd_rows(spark, monkeypatch, compress, zip64):
    path = fresh_path(spark, "warc")
    extra = spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 AS payload", "2 AS digest", "3 AS first", "4 AS n_bytes", "5 AS value")
    warc.write(extra.repartition(3), path, compress=compress, zip64=zip64)
    assert _read(spark, path) == _expected(ROWS)
    rows = warc.read(spark, path).collect()
    assert all(r["intact"] for r in rows)
    whole = {(int(i) if (i := r["record_id"].split(":")[-1]) else None, bytes(r["payload"])) for r in rows if r["record_type"] == "response"}
    assert (8, b"x" * 3_000_000) in whole and (7, ROWS[10][2].encode()) in whole
    uris = {r["record_id"]: r["target_uri"] for r in rows}
    assert uris["urn:page:1"] == "u%0D%0AX:%201%20%C3%A9" and uris["urn:page:9"] is None


@pytest.mark.parametrize("zip64", [False, True])
def test_files_are_zip_archives(spark, zip64):
    path = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame(ROWS, KIND).repartition(2), path, zip64=zip64)
    seen = 0
    for file in _archives(path):
        with zipfile.ZipFile(file) as z:
            assert z.testzip() is None and z.comment == b"\n"
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            data = z.read("archive/data-00000.warc.gz")
            for line in z.read("indexes/index-00000.cdxj").decode().splitlines():
                about = json.loads(line.split(" ", 2)[2])
                record = gzip.decompress(data[about["offset"]:about["offset"] + about["length"]])
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
                seen += 1
    assert seen == len(ROWS)


def test_members_ranges_and_rows_are_cut(spark, monkeypatch):
    for name, value in (("MEMBER_RECORDS", 7), ("ROW_BYTES", 200), ("RANGE_BYTES", 900), ("READ_BYTES", 700)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 5}.org/{i}", "".join(rng.choice("ab\n<>é") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(100 + i, "http://hot.org", LONG) for i in range(40)]
    path = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, KIND).coalesce(1), path)
    assert len(_archives(path)) == 1 and _read(spark, path) == _expected(rows)
    with zipfile.ZipFile(_archives(path)[0]) as z:
        assert len(z.namelist()) == 2 * 15


@pytest.mark.parametrize("deflated_index", [None, False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, deflated_index, packed):
    """Written with the standard library: without an index, with a stored one, with a deflated one."""
    records = [warc._record(i, f"http://o/{i}", b"payload %d" % i * (1 + 9_000 * (i == 2)), 0, "", None, warc.DATE) for i in range(5)]
    records = [r.replace(b"WARC-Payload-Digest: sha256:\r\n", b"") for r in records]
    if packed:
        records = [gzip.compress(r) for r in records]
    body, index, name = io.BytesIO(), "", "x.warc" + (".gz" if packed else "")
    for r in records:
        index += f"k 1 {json.dumps({'offset': str(body.tell()), 'length': str(len(r)), 'filename': name})}\n"
        body.write(r)
    with zipfile.ZipFile(tmp_path / "one.wacz", "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end"
        z.writestr(f"archive/{name}", body.getvalue())
        if deflated_index is not None:
            z.writestr("indexes/index.cdx", index, zipfile.ZIP_DEFLATED if deflated_index else zipfile.ZIP_STORED)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["target_uri"] for r in rows) == [f"http://o/{i}" for i in range(5)]
    assert {bytes(r["payload"]) for r in rows} == {b"payload %d" % i * (1 + 9_000 * (i == 2)) for i in range(5)}


def test_damage_is_reported(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no archive at all")
    with pytest.raises(Exception, match="end of central directory"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    path = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame([], KIND), path)
    assert warc.read(spark, path).collect() == []
