"""Page text, toxicity, licences and BPE."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from siftlake.llm import bpe, html_text, licenses, toxicity
from siftlake.llm.queries import vocabulary_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PAGE = """<!DOCTYPE html><html><head><title>no title</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="page has-sidebar"><header><a href="/">Site</a></header><div id="cookie-notice">We use cookies.</div>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<main><article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;&nbsp;line of the
text.<br><p>Second &#233; line, with a <a href="/x">link</a> in it.
<aside>Also read this.</aside><p>Third line.</p><form><input name=q><button>Go</button>Search</form>
<section class="post-comments"><h2>Comments</h2><article><p>Nice post!</p></article></section></article></main>
<div class="sidebar-right"><p>Around the web.</p></div><footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE, []) == ("Title & more\nFirst line of the text.\nSecond é line, with a link in it.\nThird line.")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "plain", "<article>x", "</p></div>", "&", "&#xD800;&#0;", "<a " * 50,
                                  "<div>" * 3000 + "x", "<script>never closed <p>x"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page, []), str)


def test_wrapped_pages_keep_their_text():
    long = "A sentence of the main text that goes on for some more words, as they do. " * 3
    inner = f"<nav><a href=/>Home</a></nav><h1>The title</h1><p>{long}</p><p>{long}And an end.</p><footer>us</footer>"
    want = f"The title\n{long.strip()}\n{long}And an end."
    plain = [1.0] + [0.0] * 7  # says content of any text
    for open_, close in (("<form>", "</form>"), ('<div class="right-sidebar">', "</div>"), ('<div class="side">', "</div>"),
                         ("<form><article>", "</article></form>"), ('<div id="side"><main>', "</main></div>"),
                         ('<form><div id="content">', "</div></form>"), ('<form><div class="right-sidebar">', "</div></form>")):
        assert html_text.main_text(f"<body>{open_}{inner}{close}</body>", plain) == want, open_
    # beside an article they stay boilerplate, and so do comments and teasers with an article of their own
    page = f"""<article><p>{long}</p></article><form>Search here</form><div class="right-sidebar"><p>{long * 3}</p></div>
        <div class="comments"><article><p>{long}</p></article></div><div class="related"><article><p>Read on</p></article></div>"""
    assert html_text.main_text(page, []) == long.strip()


def test_plain_pages_keep_their_text(spark):
    pages = [(1, "u", "<body><p>text</p></body>"), (2, "u", "<p>One sentence here.<p>And another one."), (3, "u", "bare words"),
             (4, "u", "<body><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul><p>Words of the page.</p></body>"), (5, "u", "")]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {
        1: "text", 2: "One sentence here.\nAnd another one.", 3: "bare words", 4: "Words of the page.", 5: ""}


def test_neighbours_and_text_outweigh_a_class():
    blocks, parents, depths = html_text.read_blocks("<article><p>one</p><div class=promo>two</div><p>three</p></article>")
    assert -html_text.TEXT_WEIGHT - 3 < blocks[1].evidence < 0
    plain = [2.0] + [0.0] * 7
    page = "<article>" + "<p>one</p>" * 3 + "<div class=promo>two</div>" + "<p>three</p>" * 3 + "</article>"
    assert "two" in html_text.main_text(page, plain) and "two" not in html_text.main_text(page, [-x for x in plain])


def _cut_cost(inside, balance, edges):
    return (sum(b for b, s in zip(balance, inside) if b > 0 and not s) - sum(b for b, s in zip(balance, inside) if b < 0 and s)
            + sum(c for u, v, c in edges if inside[u] != inside[v]))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.randoms(use_true_random=False))
def test_min_cut_is_least(n, rng):
    balance = [rng.uniform(-3, 3) for _ in range(n)]
    edges = [(u, v, rng.uniform(0, 2)) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
    best = min(_cut_cost([bool(m >> i & 1) for i in range(n)], balance, edges) for m in range(1 << n))
    for labels in (html_text.min_cut(balance, edges), html_text._max_flow(balance, edges)):
        assert _cut_cost(labels, balance, edges) == pytest.approx(best)


def test_smoothness_decides_doubtful_blocks():
    assert html_text.min_cut([4.0, -0.5, 4.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert html_text.min_cut([-4.0, 0.5, -4.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [False, False, False]


def test_page_query(spark):
    rows = entry.queries()["op2_html"](spark, SF).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:  # these pages keep their text in <article>
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        reader = html_text._Reader()
        reader.feed(inner)
        reader.close()
        reader._end_block()
        assert r["text"] == "\n".join(b.text for b in reader.blocks) and r["n_chars"] == len(r["text"])


def test_page_tables(spark):
    kind = "page_id long, url string, html string, text int"
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0
    rows = html_text.extract(spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", PAGE, 2)], kind)).collect()
    assert sorted(r["n_chars"] for r in rows)[:2] == [0, 0] and len(rows) == 3


def _brute_segments(scores):
    """Maximal-scoring subsequences by their definition: every proper part scores less, and no longer
    run with that property holds it."""
    n, total = len(scores), np.concatenate([[0], np.cumsum(scores)])
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1)
            if all(total[i] < total[k] for k in range(i + 1, j + 1)) and all(total[k] < total[j] for k in range(i, j))]
    return sorted(g for g in good if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in good))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_segments_are_maximal(scores):
    got = toxicity.segments(scores)
    assert sorted((s, e) for s, e, _ in got) == _brute_segments(scores)
    assert all(x == pytest.approx(sum(scores[s:e])) for s, e, x in got)


def _labelled(n, rng):
    words = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(3, 8) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Scum,", "trash", "zorgel" + rng.choice(["ta", "mi", "ou", "xx"])]))
        docs.append((i, " ".join(text), "en", "s", 0))
        if i % 10 < 6:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(1500, random.Random(2))
    df = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = toxicity.score(df, model).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    some = next(r for r in rows if r["predicted"])
    found = docs[some["doc_id"]][1].split()
    assert any(w.strip(",").lower()[:4] in ("scum", "tras", "zorg") for p in some["passages"] for w in found[p["start"]:p["end"]])


def test_toxicity_query_learns_nothing_from_held_out_labels(spark):
    docs, labels = _labelled(400, random.Random(6))
    df = spark.createDataFrame(docs, DOCS)
    import zlib
    turned = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit(df, spark.createDataFrame(x, kind)) for x in (labels, turned))
    assert a.scores == b.scores and (a.base, a.slope) == (b.base, b.slope)


def test_toxicity_of_odd_rows(spark):
    kind = "doc_id long, quality int, toxic int"
    df = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a " * 50_000, "en", "s", 0)], DOCS)
    for labels in ([], [(1, 0, None)], [(1, 0, 1), (2, 0, 0), (1, 0, 0)]):
        model = toxicity.fit(df, spark.createDataFrame(labels, kind))
        rows = toxicity.score(df, model).collect()
        assert len(rows) == 4 and all(r["predicted"] == 0 for r in rows)
    named = df.withColumnsRenamed({"lang": "_text", "source": "score"})
    assert toxicity.drop_toxic(named, spark.createDataFrame([], kind)).columns == named.columns
    assert toxicity.score(spark.createDataFrame([], DOCS), toxicity.Model()).count() == 0


NOTICE = "This work is licensed under the GNU General Public License, version 3."


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_common_and_ordered():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]
        b = [x for x in a if rng.random() < 0.8] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        pairs = licenses.align(a, 0, len(a), b, 0, len(b))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < i2 and j < j2 for (i, j), (i2, j2) in zip(pairs, pairs[1:])) and len(pairs) <= _lcs(a, b)


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(100):
        places = rng.sample(range(30), rng.randint(0, 9))
        got = licenses._increasing(list(enumerate(places)))
        best = max((bin(m).count("1") for m in range(1 << len(places)) if (lambda p: p == sorted(p))(
            [x for k, x in enumerate(places) if m >> k & 1])), default=0)
        assert len(got) == best


def test_notices():
    known = licenses.templates()
    text = "A the of. " * 300 + NOTICE + " and more " + NOTICE.replace("work", "Work itself").upper() + " the end " * 50
    found = licenses.find(text, known)
    assert [f[0] for f in found] == ["GPL-3.0", "GPL-3.0"] and found[0][3:] == (12, 12) and found[0][1:3] == (900, 912)
    assert [f[0] for f in licenses.find("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", known)] == ["CC-BY-NC-4.0", "MIT"]
    assert [f[0] for f in licenses.find(" ".join([NOTICE] * 5), known)] == ["GPL-3.0"] * 5
    assert licenses.find(None, known) == licenses.find("licensed " * 2000, known) == licenses.find("The general public", known) == []


def test_license_query_finds_every_notice(spark):
    rows = entry.queries()["op6_licenses"](spark, SF).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, notice, _ in licenses.NOTICES:
            if notice in r["text"]:
                assert (r["doc_id"], name) in found
    best = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        best[r["doc_id"]] = licenses.words_of(r["text"])
    for r in rows:
        span = best[r["doc_id"]][r["start_word"]:r["end_word"]]
        assert max(_lcs(span, t.words) for t in licenses.templates() if t.name == r["license"] and len(t.words) == r["template_words"]) >= r["matched"]


GPL_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
              "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")


@pytest.mark.parametrize("name,text", [
    ("GPL-3.0", GPL_HEADER), ("GPL-3.0", GPL_HEADER.replace("program", "library")), ("GPL-3.0", GPL_HEADER.replace(" any", "")),
    ("GPL-3.0", GPL_HEADER.replace("modify", "also modify")), ("GPL-2.0", GPL_HEADER.replace("version 3", "version 2")),
    ("LGPL-3.0", GPL_HEADER.replace("GNU", "GNU Lesser")), ("AGPL-3.0", GPL_HEADER.replace("GNU", "GNU Affero")),
    ("LGPL-2.1", GPL_HEADER.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
                " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin "
                "Street, Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"), ("MIT", "Released under the terms of the MIT License"),
    ("Unlicense", "This is free and unencumbered software given into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event shall the authors be held liable "
             "for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, Jane has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with it."),
])
def test_usual_wordings(name, text):
    found = licenses.find("Some words before. " * 5 + text + " And some behind." * 5, licenses.templates())
    assert [f[0] for f in found] == [name]


def test_license_tables(spark):
    df = spark.createDataFrame([(1, NOTICE, "en"), (1, NOTICE, "en"), (None, None, None)], "doc_id long, text string, license string")
    assert licenses.scan(df).count() == 2 and licenses.scan(df.limit(0)).count() == 0


ODD_TEXTS = [None, "", " ", "  a  b ", "a\n\n b\t\tc  ", "<|endoftext|>", " <|endoftext|> x<|endoftext|> y  z",
             "it's we'll  don't 123 45", "a b   c  d", "　x 　 y", "é ñ 漢字 🙂 🙂", "x" * 5000, "a " * 9000,
             "\u0085 a \u0085b", "a​ b", "a \x1c b\x1d c", " \x1f x", "\r\n \r\n a", "'s 't ' s"]


def test_bpe_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", ".", "é", " ", "🙂", "<|endoftext|>", "Z", " ", "\x1e"]
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, "".join(rng.choices(alphabet, k=60))) for i in range(200)]
    docs += [(5, "again"), (None, "no id"), (5, "again")]
    path = vocabulary_path()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", __import__("pyspark").sql.functions.lit(1))
    for block in (bpe.BLOCK, 300):  # of one block and of many
        monkeypatch.setattr(bpe, "BLOCK", block)
        rows = bpe.decode(bpe.encode(df, path, decoded="back"), path).collect()
        library = Tokenizer.from_file(path)
        assert len(rows) == len(docs)
        for r in rows:
            want = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["back"] == r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")


def test_bpe_query_digests(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op7_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path()).count() == 0
