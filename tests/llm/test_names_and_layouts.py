"""Column names that clash, texts without words, and tables in other layouts."""

import random
from collections import Counter

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftlake.llm import bpe, chat, exact_dedup, mixing, sharding
from siftlake.llm.queries import vocabulary_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(i % 40, " ".join(rng.choice("abcdefgh") for _ in range(i % 9)), "en", f"s{i % 3}", i % 5)
                                  for i in range(120)], DOCS)


def test_texts_without_words_are_not_taken(spark):
    rows = [(i, "", "en", "a", 0) for i in range(40)] + [(100, "one two", "en", "a", 7), (101, " \t", "en", "b", 2), (102, None, "en", "b", 0)]
    rows += [(200 + i, "many words " * 50, "en", "c", 9) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: (r["times"], r["taken"]) for r in mixing.mix(df).collect()}
    assert all(taken[r[0]] == (0, 0) for r in rows if not (r[1] or "").strip())
    got = Counter(r["doc_id"] for r in mixing.take_mix(df).collect())
    assert got == {i: n for i, (n, _) in taken.items() if n} and got[100] == 3


@pytest.mark.parametrize("names", [["_sha", "_sha2", "_points2", "_name", "_name2", "id", "digest"],
                                   ["_mix_source", "_mix_times", "_mix_below", "_mix_copy", "size", "h", "times"]])
def test_helper_columns_may_have_any_name(docs, names):
    """A column of the user's with the name of a helper stays as it is."""
    odd = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for stage in (exact_dedup.drop_duplicates, mixing.take_mix):
        made = stage(odd)
        assert made.columns == odd.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in made.collect() for n in names)
        assert sorted(map(repr, made.select(docs.columns).collect())) == sorted(map(repr, stage(docs).collect()))


def test_names_of_results_are_refused(docs):
    for name in ("position", "shard", "SLOT"):
        with pytest.raises(ValueError, match="already has a column"):
            sharding.shard(docs.withColumn(name, F.lit(1)), 3)
    with pytest.raises(ValueError, match="already has a column ids"):
        bpe.encode(docs.withColumn("ids", F.lit(1)), vocabulary_path())
    heavy = docs.limit(1).withColumn("_n", F.lit(5)).withColumn("_at", F.lit(6))
    heavy = heavy.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("k")
    rows = sharding.shard(heavy, 4, bucket_bytes=64).collect()
    assert len(rows) == 50 and {(r["_n"], r["_at"]) for r in rows} == {(5, 6)}


def test_shards_do_not_depend_on_the_layout(spark, docs):
    def made(df, partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return sorted(map(repr, sharding.shard(df, 5, bucket_bytes=300).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    one = made(docs, 4)
    assert one == made(docs.repartition(7), 9) == made(docs.orderBy(F.desc("text")), 2)
    plan = sharding.shuffled(docs, bucket_bytes=300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_bucket") <= 3  # of the records, and twice of the few starts
    other = sorted(map(repr, sharding.shard(docs, 5, seed=1, bucket_bytes=300).collect()))
    assert one != other


def test_laws_of_the_shard_query(spark):
    rows = entry.queries()["op1_sharding"](spark, SF).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


@given(st.lists(st.binary(max_size=300), max_size=40))
def test_packed_lists_come_back(parts):
    assert bpe._unpack(bpe._pack(parts)) == parts
    wide = [p * 4 for p in parts]
    assert bpe._unpack(bpe._pack(wide, 4), 4) == wide


def test_each_word_is_reported_once_per_block_and_bucket():
    words = {"a", " b,", " b", " b!", "\n", " c-d.", " 漢字", "x" * 70_000, " \x00y"}
    units = bpe._units(words, 5)
    flat = [u for part in units.values() for u in part]
    assert len(flat) == len(set(flat)) and set(flat) == {"a", " b", ",", "!", "\n", " c-d.", " 漢字", "x" * 70_000, " \x00y"}
    assert all(part == sorted(part) for part in units.values())
    assert bpe._unpack(bpe._pack([u.encode() for u in units[min(units)]])) == [u.encode() for u in units[min(units)]]


def test_answers_must_fit_the_reports():
    """A block whose documents changed between the two reads is refused, not answered wrongly."""
    import pyarrow as pa

    units = bpe._units({"a", " b"}, 1)[0]
    ids = bpe._pack([b"\x01\0\0\0"] * len(units), 4)
    table = pa.table({"block": [0], "bucket": [0], "mark": [bpe._mark([u.encode() for u in units])], "ids": [ids]})
    assert bpe._table(["a", " b"], 1, table) == [b"\x01\0\0\0"] * 2
    with pytest.raises(RuntimeError):
        bpe._table(["a", " b", " c"], 1, table)
    with pytest.raises(RuntimeError):  # as many words, but others
        bpe._table(["a", " c"], 1, table)
    with pytest.raises(RuntimeError):
        bpe._table(["a"], 1, table.slice(0, 0))


def test_empty_turns_fill_windows(spark):
    turns = spark.createDataFrame([(1, i, "user", "") for i in range(2_000)], "conv_id long, turn long, role string, text string")
    made = chat.windows(turns)
    assert made.count() == 8 and made.agg(F.max("n_turns")).first()[0] <= chat.BUDGET + chat.HISTORY
    assert chat.read_back(made).first()["n_turns"] == 2_000
