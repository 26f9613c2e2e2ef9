"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np

from siftlake.llm import exact_dedup, near_dedup
from siftlake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _row(i, text):
    return (i, text, "en", "s", 0)


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = ["a b c", "abc", " a\tb\nc ", "", None, "   ", "x" * 60_000, "é a", "éa", " a", "a"]
    docs = [_row(i, rng.choice(texts)) for i in rng.sample(range(1000), 120)] + [_row(None, "abc"), _row(5000, "abc"), _row(5000, "abc")]
    rows = exact_dedup.duplicate_groups(spark.createDataFrame(docs, DOCS), runs=13, fan_in=3).collect()
    assert len(rows) == len(docs)
    groups = {}
    for i, t, *_ in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    kept = 0
    for r in rows:
        plain = next(p for p in groups if hashlib.sha256(p.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[plain])
        assert r["keep_id"] == (None if best[1] else best[2]) and r["group_size"] == len(groups[plain])
        kept += r["kept"]
    assert kept == len(groups)
    assert exact_dedup.drop_duplicates(spark.createDataFrame(docs, DOCS)).count() == len(groups)


def test_exact_of_empty_table_and_extra_columns(spark):
    assert exact_dedup.duplicate_groups(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a", 1, 2), (2, "a ", 3, 4), (2, "a ", 3, 4)], "doc_id long, text string, kept int, _sha int")
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(2, "a ", 3, 4)]


def _sets(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def _groups(docs):
    sets = _sets(docs)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, sets


def _near_copies(rng):
    docs, n = [], 0
    for _ in range(6):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(2, 25)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 9999)}"
            docs.append(_row(n * 7 % 1009, " ".join(words).title() if rng.random() < 0.2 else "  ".join(words)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(20):  # a shared passage, too little for a link
        docs.append(_row(n * 7 % 1009, passage + " " + " ".join(f"q{rng.randint(0, 9999)}" for _ in range(30))))
        n += 1
    return docs + [_row(2000, ""), _row(2001, None), _row(2002, "one two"), _row(2003, "ONE\ttwo"), _row(2004, "one two three"), _row(2005, " \n")]


def test_near_groups(spark):
    docs = _near_copies(random.Random(4))
    want, sets = _groups(docs)
    for parts in (1, 5):
        rows = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(parts, "doc_id")).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_near_threshold_is_the_callers(spark):
    def pair(i, changed):  # 96 shingles, of which the last ``changed`` differ
        words = [f"t{i}w{k}" for k in range(100)]
        return [_row(i, " ".join(words)), _row(i + 1, " ".join(words[:100 - changed] + [f"t{i}v{k}" for k in range(changed)]))]

    docs = [*pair(10, 5), *pair(20, 10), *pair(30, 11)]  # 91/101, 86/106 = 0.811, 85/107 = 0.794
    df = spark.createDataFrame(docs, DOCS)
    for percent, gone in ((None, {11}), (85, {11}), (80, {11, 21}), (79, {11, 21, 31})):
        more = {} if percent is None else {"percent": percent}
        rows = near_dedup.near_duplicates(df, **more).collect()
        assert {r["doc_id"] for r in rows if not r["kept"]} == gone
        left = {r["doc_id"] for r in near_dedup.drop_near_duplicates(df, **more).collect()}
        assert left == {d[0] for d in docs} - gone


def test_overlooked_pairs_are_rare():
    assert near_dedup.shared_bands(85) == 4 and near_dedup.shared_bands(80) == 2
    assert all(near_dedup.missed(p, near_dedup.shared_bands(p)) <= near_dedup.MISS for p in (80, 85, 90, 99))


def test_near_odd_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    docs = [_row(3, text), _row(3, text), _row(4, text + " x"), _row(None, text), _row(None, None), _row(9, "w " * 100_000)]
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("lang", "_kept_id")
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == 6 and {r["doc_id"]: r["component_id"] for r in rows} == {3: 3, 4: 3, None: None, 9: 9}
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 3, 9]


def test_one_id_with_different_texts_loses_none(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = [(1, one, "en", "t", 0), (1, one, "en", "s", 9), (1, two, "en", "s", 0), (2, two + " end", "en", "s", 0),
            (3, "", "en", "s", 0), (3, None, "en", "s", 0), (3, "c", "en", "s", 0), (None, one, "en", "s", 0)]
    for parts in (1, 4):
        left = near_dedup.drop_near_duplicates(spark.createDataFrame(docs, DOCS).repartition(parts)).collect()
        assert sorted((r["doc_id"] or 0, r["text"], r["source"], r["n_chars"]) for r in left) == sorted(
            [(1, one, "s", 9), (1, two, "s", 0), (3, "", "s", 0), (3, "c", "s", 0), (0, one, "s", 0)])


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(12):
        docs.append(_row(100 - k, " ".join(words)))
        words[k * 15] = f"new{k}"
    want, _ = _groups(docs)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    a, b = near_dedup.superminhash([np.unique(base), np.unique(other)])
    assert abs((a == b).mean() - 300 / 500) < 0.15
    small = near_dedup.superminhash([base[:1], base[:3], base])
    assert np.isfinite(small).all() and (small[0] < near_dedup.LANES).all()
    # one element: a permutation, so every level occurs once
    assert sorted(np.floor(small[0]).astype(int)) == list(range(near_dedup.LANES))
    # a set's signature is the minimum of its elements', however they are dealt
    parts = near_dedup.superminhash([base[i:i + 1] for i in range(50)]).min(axis=0)
    assert np.array_equal(parts, near_dedup.superminhash([base[:50]])[0])


def test_components_of_random_edges(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()
    want = {x: top(x) for e in edges for x in e if top(x) != x}
    assert {r["u"]: r["v"] for r in rows} == want and len(rows) == len(want)
