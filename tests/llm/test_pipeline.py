"""The pipeline, stage by stage, against plain Python."""

import hashlib
import re

import pytest

import corpus_pipeline
from siftlake.llm import mixing, toxicity
from siftlake.llm.common import read
from siftlake.session import cut
from tests.conftest import SF
from tests.llm.test_dedup import _sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        out.append(docs)
    return [read(spark, SF, "documents"), *out]


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], read(spark, SF, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(stages[0], model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == {r["doc_id"] for r in stages[0].collect()} - bad


def test_one_of_equal_texts_stays(stages):
    best = {}
    for r in stages[1].collect():
        key = re.sub("[\x20\x09-\x0d]", "", r["text"])
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in stages[2].collect()} == {i for _, i in best.values()}


def test_near_stage_links_from_80_percent_on(stages):
    """Brute force over all pairs of the stage's input: components at 0.80, the smallest id stays."""
    sets = _sets([tuple(r) for r in stages[2].collect()])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(i for i in root if top(i) == i)


def test_mix_takes_effect(stages):
    want = {r["doc_id"]: r["times"] for r in mixing.mix(stages[3]).collect()}
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_tokens(stages):
    from tokenizers import Tokenizer

    from siftlake.llm.queries import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows[:60]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_odd_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", None, None, None), (1, None, None, None, None), (2, "a b", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF), "odd")
        assert docs.count() <= max(1, 3 * len(rows))
