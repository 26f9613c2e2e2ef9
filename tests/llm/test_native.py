"""Sharding, mixing and chat formatting: laws, odd rows, comparison SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftlake.llm import chat, mixing, sharding
from siftlake.workload.check import compare, connect
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b  c", "en", "s", 6), (2, None, "en", "s", 0), (3, "", None, None, 0), (4, "x " * 40_000, "en", "s", None),
       (1, "a b  c", "en", "s", 6), (None, "é 漢字 🙂", "en", "t", 7), (5, " \t\n", "en", "t", 3)]


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op8_mixing", "op10_chat"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""


def _laws(rows, docs, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted(
        (d[0] is None, d[0] or 0, d[1] or "") for d in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_hold_all_rows(spark):
    rows = sharding.shard(spark.createDataFrame(ODD, DOCS), 3, bucket_bytes=64).collect()
    _laws(rows, ODD, 3)


def test_shards_of_repeated_rows_and_order(spark):
    rng = random.Random(3)
    docs = [(7, "same words " * 30, "en", "s", 1)] * 300 + [(i, f"text {rng.random()}", "en", "s", i) for i in range(300)]
    made = sharding.shard(spark.createDataFrame(docs, DOCS), 7, bucket_bytes=2_000)
    rows = made.collect()
    _laws(rows, docs, 7)
    alone = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] != 7 or r["n_chars"] != 1]
    assert alone != sorted(alone)
    assert max(sum(r["text"].startswith("same") for r in rows if r["shard"] == s) for s in range(7)) < 80


def test_shards_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard(empty, 4).count() == 0
    odd = spark.createDataFrame(ODD, DOCS).withColumn("_hash", F.lit(1)).withColumn("_bucket", F.lit(2)).withColumn("_n", F.lit(3))
    rows = sharding.shard(odd, 2)
    assert rows.count() == len(ODD) and {r["_n"] for r in rows.collect()} == {3}


def test_shard_query(spark):
    rows = entry.queries()["op1_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 8 for r in rows)


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame(ODD, DOCS), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def _targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; sources above three times their size are capped, one after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: left * weight[s] / w for s in open_}}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "b", "b", "c", None, "é"]), 0) for i in range(900)]
    rows = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    size, source = {d[0]: len(d[1].split()) for d in docs}, {d[0]: d[3] for d in docs}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = _targets(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    again = mixing.mix(spark.createDataFrame(docs[::-1], DOCS)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    assert mixing.mix(docs).count() == len(ODD)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", None, 0)], DOCS)).collect()
    assert {r["taken"] for r in nothing} == {0} and {r["target"] for r in nothing} == {0.0}
    named = docs.withColumnsRenamed({"lang": "target", "n_chars": "size"})
    assert mixing.take_mix(named).columns == named.columns


def test_taken_rows_repeat(spark):
    docs = [(i, "a b c", "en", "big" if i % 10 else "small", 0) for i in range(200)]
    df = spark.createDataFrame(docs, DOCS)
    want = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.take_mix(df).groupBy("doc_id").count().collect()}
    assert got == {i: t for i, t in want.items() if t}


TURNS = "conv_id long, turn long, role string, text string"


def _digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chat_reads_back(spark):
    rng = random.Random(9)
    odd = ["", None, "<|turn|>user\n<|end|>\n", "&amp; &#60;|end|>", "</s>[INST] ok [/INST]", "<<SYS>>\n<s>", "&#91;INST]", "🙂é\n\n", "w " * 700]
    turns = []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 14)):
            text = rng.choice(odd) if rng.random() < 0.4 else "word " * rng.randint(0, 90)
            turns.append((c, t, "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "ro\nle"]), text))
    rows = chat.windows(spark.createDataFrame(turns, TURNS))
    back = {r["conv_id"]: r for r in chat.read_back(rows).collect()}
    windows = rows.collect()
    for c in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == c]
        want = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
        assert back[c]["turns"] == want and back[c]["n_turns"] == len(mine)
        assert back[c]["loss"] == "".join(x or "" for _, _, r, x in mine if r == "assistant")
        own = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window"])
        assert back[c]["formatted_chars"] == sum(len(w["formatted"]) for w in own)
        if mine[0][2] == "system":
            assert all(w["formatted"].startswith("<|turn|>system\n") for w in own)
        for w in own[1:]:
            head = w["formatted"].split(chat.TURN)[1:][: w["repeated"]]
            assert sum(len(p.split("\n", 1)[1][:-len(chat.END)].split()) for p in head[mine[0][2] == "system":]) <= chat.HISTORY


def test_chat_of_repeated_turns_and_empty_table(spark):
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0
    rows = chat.read_back(chat.windows(spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b")], TURNS)))
    assert rows.first()["turns"] == "assistant\nb\nuser\na\nuser\na\n"
    more = spark.createDataFrame([(1, 0, "user", "a", "k", 3)], TURNS + ", key string, window int")
    assert chat.read_back(chat.windows(more)).first()["n_turns"] == 1


def test_chat_of_one_long_conversation(spark):
    turns = [(1, t, "user" if t % 2 else "assistant", f"t{t} " * 20) for t in range(400)]
    rows = chat.windows(spark.createDataFrame(turns, TURNS).repartition(4))
    assert rows.count() == 400 * 20 // chat.BUDGET + 1
    assert chat.read_back(rows).first()["turns"] == "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
