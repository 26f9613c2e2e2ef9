"""WARC records in ZIP-packaged archives: writer and range reader.

Writing.  Every row becomes a WARC record, and every task writes one ZIP file.  Its members are
stored, not deflated: ``archive/data-00000.warc.gz`` holds records, each a gzip member of its own,
``indexes/index-00000.cdxj`` says where in it each record lies; a new pair begins after
MEMBER_RECORDS records or MEMBER_BYTES bytes, so that a task keeps a bounded index.  Of records with
equal payloads of at least ``least`` bytes, that with the smallest id is a response, the others are
revisits that refer to it and hold no payload.  Only digests that occur twice or more are joined to
the rows, as a written table: Spark broadcasts it when it is small, and otherwise joins by digest,
where its skew join splits a frequent one.

The files are written by Spark's own text writer and so by its commit protocol: a task that is lost
or runs twice leaves one file.  A writer of text rows ends each row with a line feed; the ZIP file
is cut at line feeds into rows, and its last one is the comment of the archive.

Reading.  ``binaryFile`` lists the archives without their content.  A task reads the end of each,
its central directory (ZIP64 too) and its indexes; a WARC member that no index covers is walked
record by record.  The records found are dealt by archive and range, and tasks read those ranges
alone, so one archive can be read by many tasks and nothing is extracted.  Files are opened with
``pyarrow.fs``, which must know the storage of the archives.

A null payload is empty.  Rows of one id and one payload are all responses or all revisits of one;
a null id comes after all others, and if all of a group are null each is a response.  A null address
is left out of its record and comes back null.  Characters that a header cannot hold are percent
encoded in the address.  An empty table gives no archive, and no archives give no rows.  Other
columns of the input play no part."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlake.llm.common import ship
from siftlake.session import cut

LEAST = 100  # bytes from which equal payloads are stored once
MEMBER_RECORDS, MEMBER_BYTES = 50_000, 256 << 20
ROW_BYTES = 1 << 20  # of the text rows that make up an archive
RANGE_BYTES = 32 << 20  # of an archive that a task reads
READ_BYTES, GAP = 4 << 20, 64 << 10  # one request reads so much at most, and over gaps up to this
DATE = "1970-01-01T00:00:00Z"

# Signatures and sizes of the ZIP format.
_LOCAL, _CENTRAL, _DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08"
_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL_FORM, _CENTRAL_FORM = "<4s5H3I2H", "<4s6H3I5H2I"
_END_FORM, _END64_FORM, _LOCATOR_FORM = "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
_STREAMED, _UTF8, _DAY = 0x08, 0x800, 0x21  # flags; the first of January 1980
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else urllib.parse.quote(c, safe="") for c in url)


def _index_key(url: str | None) -> str:
    """Host from the top domain down, then the rest of the address; one word."""
    try:
        parts = urllib.parse.urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return _uri(url or "")[:500] or "-"
    rest = parts.path + ("?" + parts.query if parts.query else "")
    return _uri(f"{host}){rest}".lower())


def _record(page_id, url, payload, n_bytes, digest, first, date) -> bytes:
    """A response, or with ``payload`` None a revisit of the record of ``first``."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block += payload or b""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Zip:
    """The bytes of a ZIP file of stored members, in order; sizes follow the data."""

    def __init__(self, zip64: bool):
        self.at, self.zip64, self.entries = 0, zip64, []

    def begin(self, name: str) -> bytes:
        self.name, self.start, self.size, self.crc = name.encode(), self.at, 0, 0
        out = struct.pack(_LOCAL_FORM, _LOCAL, 20, _STREAMED | _UTF8, 0, 0, _DAY, 0, 0, 0, len(self.name), 0) + self.name
        self.at += len(out)
        return out

    def add(self, data: bytes) -> bytes:
        self.size, self.crc, self.at = self.size + len(data), zlib.crc32(data, self.crc), self.at + len(data)
        return data

    def finish(self) -> bytes:
        if self.size > _MAX32:
            raise ValueError(f"member {self.name!r} has more than 4 GiB")
        out = _DESCRIPTOR + struct.pack("<3I", self.crc, self.size, self.size)
        self.entries.append((self.name, self.crc, self.size, self.start))
        self.at += len(out)
        return out

    def close(self) -> bytes:
        """Central directory and end; the comment is the line feed that ends the last row."""
        out = b""
        for name, crc, size, start in self.entries:
            extra = b""
            if self.zip64 or start >= _MAX32:
                extra, size32, start32 = struct.pack("<2H3Q", 1, 24, size, size, start), _MAX32, _MAX32
            else:
                size32, start32 = size, start
            out += struct.pack(_CENTRAL_FORM, _CENTRAL, 45, 45 if extra else 20, _STREAMED | _UTF8, 0, 0, _DAY, crc, size32,
                               size32, len(name), len(extra), 0, 0, 0, 0, start32) + name + extra
        n, start, size = len(self.entries), self.at, len(out)
        if self.zip64 or n >= _MAX16 or start + size >= _MAX32:
            out += struct.pack(_END64_FORM, _END64, 44, 45, 45, 0, 0, n, n, size, start)
            out += struct.pack(_LOCATOR_FORM, _LOCATOR64, 0, start + size, 1)
            n, size, start = _MAX16, _MAX32, _MAX32
        return out + struct.pack(_END_FORM, _END, 0, 0, n, n, size, start, 1) + b"\n"


def _archive(rows: Iterator[dict], compress: bool, zip64: bool, date: str) -> Iterator[bytes]:
    """The pieces of the ZIP file with the records of ``rows``."""
    zipped, lines, part = _Zip(zip64), [], 0

    def whole_index() -> Iterator[bytes]:
        yield zipped.finish()
        yield zipped.begin(f"indexes/index-{part:05d}.cdxj")
        yield zipped.add("".join(sorted(lines)).encode())
        yield zipped.finish()

    for row in rows:
        if lines and (len(lines) >= MEMBER_RECORDS or zipped.size >= MEMBER_BYTES):
            yield from whole_index()
            lines, part = [], part + 1
        name = f"data-{part:05d}.warc" + (".gz" if compress else "")
        if not lines:
            yield zipped.begin(f"archive/{name}")
        data = _record(*(row[c] for c in ("page_id", "url", "payload", "n_bytes", "digest", "first")), date)
        if compress:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
        about = {"url": row["url"], "digest": f"sha256:{row['digest']}", "length": len(data), "offset": zipped.size, "filename": name}
        stamp = re.sub(r"\D", "", date)
        lines.append(f"{_index_key(row['url'])} {stamp} {json.dumps(about)}\n")
        yield zipped.add(data)
    if lines:
        yield from whole_index()
        yield zipped.close()


def _text_rows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes cut at line feeds, which the writer of the rows puts back."""
    kept, size = [], 0
    for piece in pieces:
        kept.append(piece)
        size += len(piece)
        if size >= ROW_BYTES:
            row, feed, rest = b"".join(kept).rpartition(b"\n")
            if feed:
                yield row
            kept, size = [rest], len(rest)
    if size:
        yield b"".join(kept)[:-1]  # the archive ends with a line feed


def _write_task(compress: bool, zip64: bool, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 100) for row in batch.slice(at, 100).to_pylist())
        for row in _text_rows(_archive(rows, compress, zip64, date)):
            yield pa.record_batch({"value": pa.array([row], pa.binary())})
    return run


def roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null for a revisit), n_bytes, digest, first (id of the response that a
    revisit refers to)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
            .withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256)))
    often = cut(rows.where(F.col("n_bytes") >= least).groupBy("digest")
                .agg(F.min("page_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    again = F.col("least_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least_id"))
    return (rows.join(often, "digest", "left")
            .select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "n_bytes", "digest",
                    F.when(again, F.col("least_id")).alias("first")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
          least: int = LEAST, compress: bool = True, zip64: bool = False, date: str = DATE) -> None:
    """Write the archives into the folder ``path``: one ZIP file for each partition that has rows.
    ``zip64`` writes the 64-bit structures even where none is needed."""
    pieces = roles(pages, id_col, url, payload, least).mapInArrow(_write_task(compress, zip64, date), "value binary")
    (pieces.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 0)
     .option("lineSep", "\n").option("compression", "none").text(path))


def _open(path: str):
    """A random-access file.  Paths are as Spark lists them."""
    if "://" not in path or path.startswith("file:"):
        return pa.fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    scheme, rest = re.sub("^s3[an]://", "s3://", path).split("://", 1)
    system, inner = pa.fs.FileSystem.from_uri(f"{scheme}://{urllib.parse.quote(rest)}")
    return system.open_input_file(urllib.parse.unquote(inner))


def _range(file, start: int, size: int) -> bytes:
    data = file.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"archive ends within the {size} bytes from {start} on")
    return data


def members(file, length: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, start of the data, stored size, full size) of each member, from the central
    directory, with the ZIP64 one where the plain one refers to it."""
    tail_at = max(0, length - 22 - _MAX16)
    tail = _range(file, tail_at, length - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)  # the same four bytes inside a comment or a member
    if at < 0:
        raise ValueError("no ZIP file: it has no end of central directory")
    _, _, _, _, n, size, start, _ = struct.unpack_from(_END_FORM, tail, at)
    if n == _MAX16 or size == _MAX32 or start == _MAX32:
        before = tail_at + at - 20
        if before >= 0 and (found := struct.unpack(_LOCATOR_FORM, _range(file, before, 20)))[0] == _LOCATOR64:
            end64 = struct.unpack(_END64_FORM, _range(file, found[2], 56))
            if end64[0] != _END64:
                raise ValueError("ZIP64 end of central directory expected")
            n, size, start = end64[7:10]
    directory, at, out = _range(file, start, size), 0, []
    for _ in range(n):
        entry = struct.unpack_from(_CENTRAL_FORM, directory, at)
        if entry[0] != _CENTRAL:
            raise ValueError("central directory entry expected")
        flags, method, stored, full, name_size, extra_size, comment_size, header = (entry[i] for i in (3, 4, 8, 9, 10, 11, 12, 16))
        name = directory[at + 46:at + 46 + name_size]
        extra = directory[at + 46 + name_size:at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:  # 64-bit values, only for the fields that are full
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = next(wide) if full == _MAX32 else full
                stored = next(wide) if stored == _MAX32 else stored
                header = next(wide) if header == _MAX32 else header
            extra = extra[4 + width:]
        local = struct.unpack(_LOCAL_FORM, _range(file, header, 30))  # its name and extra field may differ in length
        if local[0] != _LOCAL:
            raise ValueError("local header expected")
        out.append((name.decode("utf-8" if flags & _UTF8 else "cp437"), method, header + 30 + local[9] + local[10], stored, full))
        at += 46 + name_size + extra_size + comment_size
    return out


def _lines(file, start: int, stored: int, method: int) -> Iterator[str]:
    """The lines of an index, read piece by piece."""
    unpack, rest = (zlib.decompressobj(-15) if method else None), b""
    for at in range(start, start + stored, READ_BYTES):
        data = _range(file, at, min(READ_BYTES, start + stored - at))
        *whole, rest = (rest + (unpack.decompress(data) if unpack else data)).split(b"\n")
        yield from (line.decode() for line in whole)
    if rest:
        yield rest.decode()


def _walk(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a WARC member that no index covers."""
    at, end = start, start + size
    packed = size >= 2 and _range(file, start, 2) == b"\x1f\x8b"
    while at < end:
        if packed:
            unpack, read = zlib.decompressobj(31), at
            while not unpack.eof:
                if read >= end:
                    raise ValueError("WARC member ends within a record")
                data = _range(file, read, min(GAP, end - read))
                unpack.decompress(data)
                read += len(data)
            length = read - len(unpack.unused_data) - at
        else:
            head, want = b"", 0
            while b"\r\n\r\n" not in head:
                want += GAP
                if len(head) == end - at:
                    raise ValueError("WARC member ends within a header")
                head = _range(file, at, min(want, end - at))
            head, _, _ = head.partition(b"\r\n\r\n")
            length = len(head) + 4 + int(_headers(head)["content-length"]) + 4
        yield at, length
        at += length


def _found(path: str, length: int) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of every record."""
    with _open(path) as file:
        listed = members(file, length)
        data = {name.rsplit("/", 1)[-1]: (name, method, start, stored) for name, method, start, stored, _ in listed
                if re.search(r"\.warc(\.gz)?$", name)}
        for name, method, *_ in data.values():
            if method:
                raise ValueError(f"{path}: {name} is deflated; only stored members can be read by ranges")
        covered = set()
        for name, method, start, stored, _ in listed:
            if re.search(r"\.cdxj?$", name):
                for line in _lines(file, start, stored, method):
                    about = line[line.find("{"):] if "{" in line else ""
                    if about and (entry := json.loads(about)).get("filename", "").rsplit("/", 1)[-1] in data:
                        member = entry["filename"].rsplit("/", 1)[-1]
                        covered.add(member)
                        yield path, data[member][2] + int(entry["offset"]), int(entry["length"])
        for member, (_, _, start, stored) in data.items():
            if member not in covered:
                yield from ((path, at, n) for at, n in _walk(file, start, stored))


_WHERE = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.to_pylist():
            rows = []
            for row in _found(one["path"], one["length"]):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _WHERE.types)], schema=_WHERE)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _WHERE.types)], schema=_WHERE)


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower().decode("latin-1"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
                     ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                     ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("intact", pa.bool_()), ("payload", pa.binary())])


def _parsed(archive: str, offset: int, length: int, data: bytes, payloads: bool) -> dict:
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError(f"{archive}: no WARC record at {offset}")
    about = _headers(head)
    block = rest[:int(about["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if about.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind, declared = about.get("warc-type"), about.get("warc-payload-digest", "").removeprefix("sha256:") or None
    size = int(_headers(http).get("content-length", len(payload))) if http else len(payload)
    if kind == "revisit":
        digest, intact, payload = declared, True, None
    else:
        digest = hashlib.sha256(payload).hexdigest()
        intact, size = size == len(payload) and declared in (None, digest), len(payload)
    return {"archive": archive, "offset": offset, "length": length, "record_type": kind,
            "record_id": about.get("warc-record-id", "").strip("<>"), "target_uri": about.get("warc-target-uri"),
            "date": about.get("warc-date"), "refers_to": about["warc-refers-to"].strip("<>") if "warc-refers-to" in about else None,
            "payload_bytes": size, "payload_digest": digest, "intact": intact, "payload": payload if payloads else None}


def _runs(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbouring records that one request reads."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - run[-1][1] - run[-1][2] > GAP or row[1] + row[2] - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _fetch(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        try:
            for batch in batches:
                for near in _runs(list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))):
                    if near[0][0] != opened:
                        if file is not None:
                            file.close()
                        opened = near[0][0]
                        file = _open(opened)
                    start = near[0][1]
                    data = _range(file, start, max(o + n for _, o, n in near) - start)
                    yield pa.RecordBatch.from_pylist(
                        [_parsed(a, o, n, data[o - start:o - start + n], payloads) for a, o, n in near], schema=_RECORD)
        finally:
            if file is not None:
                file.close()
    return run


def locate(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length of every record in the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where("length > 0").mapInArrow(_locate, "archive string, offset long, length long")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: archive, offset, length, record_type, record_id, target_uri, date,
    refers_to, payload_bytes and payload_digest (of the full payload; what a revisit declares),
    intact (size and digest are the declared ones), payload (null for revisits, and without
    ``payloads``)."""
    places = cut(locate(spark, path), "places")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    dealt = (places.withColumn("span", F.floor(F.col("offset") / RANGE_BYTES))
             .repartition(max(1, -(-total // RANGE_BYTES)), "archive", "span").sortWithinPartitions("archive", "offset"))
    kinds = ("archive string, offset long, length long, record_type string, record_id string, target_uri string, "
             "date string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary")
    return dealt.select("archive", "offset", "length").mapInArrow(_fetch(payloads), kinds)


def page_of(record: str):
    """The id of the row that a record (column of urn:page:…) was written for."""
    digits = F.substring_index(record, ":", -1)
    return F.when(digits != "", digits).cast("long")


ship(__name__)
