"""Byte-level BPE with a distinct-word table.

A text is split into words at every single space or line feed between two other characters, the
space going with the word after it; no token of the vocabulary's own split crosses such a place, so
words can be encoded one by one.  Documents are dealt into blocks, each of which reports its distinct
words once, sorted and packed by the hash of the word.  One partition so meets all reports of a word and
encodes the word once.  The answers go back to their blocks in the order of the reports; each block
joins the ids of its distinct words with the pieces of the vocabulary, and joins ids and pieces back
by position.

A text moves once, a word once per block.  A word as frequent as may be is reported once per block,
so no partition of words is larger than its share of the blocks."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from siftlake.llm.common import fresh, ship, shuffle_partitions, small_batches, unused

BLOCK = 24 << 20  # bytes of text in a block, on average
PART = 64 << 20  # bytes of text in a partition of blocks, on average
SLICE = 256  # documents of a block that are joined at a time
BUCKETS = 8_192  # at most as many partitions of words
_CACHE = 500_000  # distinct words a partition of words keeps; beyond, they are encoded again
CHANGED = "the documents came in another order when read again; write them to a table first"
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?)]}"
_ENCODERS: dict = {}


def _words(text: str) -> list[str]:
    """The text in words.  Joined, they are the text."""
    out: list[str] = []
    for line in _LINE.split(text) if "\n" in text else (text,):
        if out:
            out.append("\n")
        words = line.split()
        if not words or " ".join(words) != line:  # something other than single spaces between or around them
            words = _SPACE.split(line)
        out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


def _parts(word: str) -> tuple[str, str]:
    """Letters, after one space or none, and the marks behind them; ('', '') for other words.  The
    vocabulary's split separates letters from marks, so both can be encoded by themselves."""
    core = word.rstrip(_MARKS)
    if len(core) < len(word) and (core[1:] if core[:1] == " " else core).isalpha():
        return core, word[len(core):]
    return "", ""


# Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = re.compile(r"[\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class _Encoder:
    """Ids of single words.  Words in ASCII and Latin letters go through the merge ranks, which is
    quick; words with other characters or a special token, and vocabularies whose ids are not their
    ranks, go through the tokenizers library, which is loaded when it is needed."""

    def __init__(self, file: str):
        import json

        self.file, self.library, self.ranks = file, None, None
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.special = whole["model"], [t["content"] for t in whole.get("added_tokens") or []]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        if ids and ids[0] >= 256 and all(x < y for x, y in zip(ids, ids[1:])):
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}
            # a special token's text is no merge
            ranks = {piece: i for piece, i in ranks.items() if len(piece) == 1 or i >= ids[0]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        rest = []
        for word in words:
            if self.ranks is not None and _LATIN.fullmatch(word) and not any(t in word for t in self.special):
                yield word, self.ranks.encode_ordinary(word)
            else:
                rest.append(word)
        if rest and self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
            self.library.no_truncation()
            self.library.no_padding()
        for begin in range(0, len(rest), 4096):
            part = rest[begin:begin + 4096]
            for word, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                yield word, found.ids


def _byte_of() -> dict[str, int]:
    """A byte-level vocabulary writes each byte as one character: the printable ones of Latin-1 as
    themselves, the others, in order, as the characters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(vocabulary: str) -> _Encoder:
    name = SparkFiles.get(vocabulary)
    if name not in _ENCODERS:
        _ENCODERS[name] = _Encoder(name)
    return _ENCODERS[name]


def _share(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file with the job; its name on every executor."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _units(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The distinct units of ``words`` by bucket, sorted: reports and answers have this order."""
    units: set[str] = set()
    for word in words:
        core, marks = _parts(word)
        units.update((core, marks) if core else (word,))
    out: dict[int, list[str]] = {}
    for unit in sorted(units):
        out.setdefault(zlib.crc32(unit.encode()) % buckets, []).append(unit)
    return out


def _pack(parts: list[bytes], width: int = 1) -> bytes:
    """Byte strings as one, compressed; numbers of ``width`` bytes are laid out byte by byte."""
    lengths = np.fromiter(map(len, parts), np.int32, len(parts))
    body = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width).T.tobytes()
    whole = lengths.view(np.uint8).reshape(-1, 4).T.tobytes() + body
    return struct.pack("<qq", len(parts), len(whole)) + pa.Codec("zstd").compress(whole, asbytes=True)


def _unpack(data: bytes, width: int = 1) -> list[bytes]:
    n, size = struct.unpack_from("<qq", data)
    whole = pa.Codec("zstd").decompress(data[16:], decompressed_size=size, asbytes=True)
    lengths = np.frombuffer(whole, np.uint8, 4 * n).reshape(4, n).T.copy().view(np.int32).ravel()
    body = np.frombuffer(whole, np.uint8, offset=4 * n).reshape(width, -1).T.tobytes()
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _mark(words: list[bytes]) -> int:
    """A checksum by which a block knows that an answer belongs to its words."""
    return zlib.crc32(b"\0".join(words))


def _reports(text: int, block: int, buckets: int):
    """(block, bucket, words): the distinct words of every block of a partition, packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for at, value in zip(batch.column(block).to_pylist(), batch.column(text).to_pylist()):
                if value:
                    seen.setdefault(at, set()).update(_words(value))
        for at in list(seen):
            units = _units(seen.pop(at), buckets)
            yield pa.record_batch([
                pa.array([at] * len(units), pa.int64()), pa.array(list(units), pa.int32()),
                pa.array([_pack([u.encode() for u in part]) for part in units.values()], pa.binary())],
                names=["block", "bucket", "words"])
    return run


def _answers(vocabulary: str):
    """(block, bucket, mark, ids): each distinct word of the partition is encoded once; the answers have the
    order of the reports."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _encoder(vocabulary), {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = _unpack(batch.column(2)[i].as_py())
                if len(known) > _CACHE:
                    known.clear()
                for word, ids in encoder([w.decode() for w in words if w not in known]):
                    known[word.encode()] = array("i", ids).tobytes()
                yield pa.record_batch([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1),
                    pa.array([_mark(words)], pa.int64()), pa.array([_pack([known[w] for w in words], 4)], pa.binary())],
                    names=["block", "bucket", "mark", "ids"])
    return run


def _table(words: Iterable[str], buckets: int, answers: pa.Table) -> list[bytes]:
    """The ids, as int32 bytes, of each of the distinct ``words``, from the answers to a block's reports."""
    units, known = _units(words, buckets), {}
    for bucket, mark, ids in zip(*(answers.column(c).to_pylist() for c in ("bucket", "mark", "ids"))):
        asked = units.pop(bucket, [])
        if _mark([u.encode() for u in asked]) != mark:
            raise RuntimeError(CHANGED)
        known.update(zip(asked, _unpack(ids, 4)))
    if units:
        raise RuntimeError(CHANGED)
    split = map(_parts, words)
    return [known[core] + known[marks] if core else known[word] for word, (core, marks) in zip(words, split)]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``, the ids of the whole text: what the tokenizers library gives with
    add_special_tokens=False, the strings of special tokens in the text included.  A null text is
    an empty one and has no ids; repeated rows stay.  ``path`` is the tokenizer's JSON file, read on the
    driver; its special tokens must not contain white space.  With ``decoded``, a column of that name
    has the ids decoded again, as ``decode`` does, from the pieces that the ids of each distinct word
    of a block are joined with.  A table that has a column of either name is refused.

    ``docs`` is numbered where it is read, so it should come from a table or files, whose rows have
    the same order whenever they are read; a changed order is noticed and refused.  Sets the session's
    Arrow batches to ROWS rows."""
    spark = docs.sparkSession
    unused(docs, out, *([decoded] if decoded else []))
    small_batches(spark)
    vocabulary = _share(spark, path)
    pieces = spark.sparkContext.broadcast(id_pieces(path))  # as many as the vocabulary has
    mine, block = fresh(docs, "_text", "_block")
    plain = (text, "string") in docs.dtypes  # a text that is one already moves as it is
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    parts = max(-(-size // PART), min(blocks, shuffle_partitions(spark)))
    buckets = min(BUCKETS, max(shuffle_partitions(spark), blocks // 64))
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = docs if plain else docs.withColumn(mine, F.col(text).cast("string"))
    rows = rows.withColumn(block, F.pmod(number, F.lit(blocks))).repartition(parts, block)
    width, place = len(docs.columns), rows.columns.index(text if plain else mine)
    reports = rows.mapInArrow(_reports(place, len(rows.columns) - 1, buckets), "block long, bucket int, words binary")
    answers = reports.repartitionById(buckets, "bucket").mapInArrow(
        _answers(vocabulary), "block long, bucket int, mark long, ids binary")
    names = [*docs.columns, out, *([decoded] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())),
                           *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = defaultdict()  # a word's number in the block
        numbers.default_factory = numbers.__len__
        slices = [left.slice(begin, SLICE) for begin in range(0, left.num_rows, SLICE)]
        texts = [[array("i", map(numbers.__getitem__, _words(t))) if t else () for t in part.column(place).to_pylist()]
                 for part in slices]
        table = _table(numbers, buckets, right)
        del numbers
        words = [b"".join(map(pieces.value.__getitem__, np.frombuffer(x, np.int32).tolist())) for x in table] if decoded else []
        done = []
        for i, part in enumerate(slices):
            ids = [b"".join(map(table.__getitem__, t)) for t in texts[i]]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
            if decoded:
                more.append(pa.array([b"".join(map(words.__getitem__, t)).decode("utf-8", "replace") for t in texts[i]], pa.string()))
            texts[i] = None
            done.append(pa.Table.from_arrays([*part.columns[:width], *more], names=names))
        if not done:
            raise RuntimeError(CHANGED)
        return pa.concat_tables(done)

    return rows.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(join, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text of ``ids``: each id is joined with its piece, special tokens
    included; bytes that are no UTF-8 become U+FFFD.  Null ids give an empty text."""
    pieces = rows.sparkSession.sparkContext.broadcast(id_pieces(path))  # as many as the vocabulary has
    place = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                texts = [_joined(row.values.to_numpy(), pieces.value) if row.is_valid else "" for row in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, out])

    return rows.mapInArrow(run, schema)


def _joined(ids: np.ndarray, pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def id_pieces(path: str) -> list[bytes]:
    """The bytes of every id, special tokens included."""
    from tokenizers import Tokenizer

    vocabulary, byte = Tokenizer.from_file(path).get_vocab(with_added_tokens=True), _byte_of()
    out = [b""] * (max(vocabulary.values()) + 1)
    for text, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in text) if all(c in byte for c in text) else text.encode()
    return out


def digests(rows: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded rows."""
    listed = F.array_join(F.col(ids).cast("array<string>"), ",")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2(text, 256).alias("decoded_sha256"))


ship(__name__)
