"""Licence notices by patience alignment.

A text and a template are sequences of words.  A place in the text where one of the template's
telling words stands is an anchor; to its left and right the two are aligned: equal words next to
what is already matched, then words that occur once in both gaps, of which the longest increasing
subsequence is kept, and again within every gap between them.  The share of the template's words
that are matched is its coverage.  A notice that covers COVERAGE of a template must hold at least
one of its telling words, as there are more of these than words that may be missing."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm.common import ship

COVERAGE = 0.85
INSERTED = 1.5  # length of a notice in the text, in templates, at most
SLACK = 4  # words more than twice the template's that a gap may have

# Names, notices, and words without which a notice is of another licence.
NOTICES = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so", "sublicense"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met", "redistribution"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "affero 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "by 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "sa 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "nc 4"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "nd 4"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "nc sa 4"),
    ("MIT", "Distributed under the MIT License.", "mit"),
    ("MIT", "under the terms of the MIT License", "mit"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License.", "apache 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software.", "authors arising"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
             "to alter it and redistribute it freely, subject to the following restrictions", "alter redistribute"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work", "waived neighboring"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.", "cc0 1"),
    *((f"{short}-{number}", f"This program is free software: you can redistribute it and/or modify it under the terms of the "
       f"GNU {name} as published by the Free Software Foundation, either version {number.removesuffix('.0')} of the License, or (at your "
       f"option) any later version.", f"{must} {number.removesuffix('.0')}")
      for short, number, name, must in (
          ("GPL", "2.0", "General Public License", "gnu general"), ("GPL", "3.0", "General Public License", "gnu general"),
          ("LGPL", "2.1", "Lesser General Public License", "lesser"), ("LGPL", "3.0", "Lesser General Public License", "lesser"),
          ("AGPL", "3.0", "Affero General Public License", "affero"))),
    *((name, f"GNU {title} Version {version} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy "
       f"and distribute verbatim copies of this license document, but changing it is not allowed.", must)
      for name, title, version, year, must in (
          ("GPL-2.0", "GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991", "general 2 1991"),
          ("GPL-3.0", "GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007", "general 3 2007"),
          ("LGPL-2.1", "LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999", "lesser 2 1999"),
          ("LGPL-3.0", "LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007", "lesser 3 2007"),
          ("AGPL-3.0", "AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007", "affero 3 2007"))),
    *((f"CC-{short}-4.0", f"licensed under a Creative Commons {title} 4.0 International License", must)
      for short, title, must in (
          ("BY", "Attribution", "commons attribution 4"), ("BY-SA", "Attribution-ShareAlike", "sharealike 4"),
          ("BY-NC", "Attribution-NonCommercial", "noncommercial 4"), ("BY-ND", "Attribution-NoDerivatives", "noderivatives 4"),
          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "noncommercial sharealike 4"))),
    *((name, f"SPDX-License-Identifier: {spdx}", f"spdx {spdx}") for name, spdx in (
        ("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"),
        ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3.0"), ("AGPL-3.0", "AGPL-3.0"),
        ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"), ("Zlib", "Zlib"), ("CC0-1.0", "CC0-1.0"),
        ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
        ("CC-BY-ND-4.0", "CC-BY-ND-4.0"), ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"))),
)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; everything in ASCII but letters and digits separates them."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    must: frozenset[bytes]
    telling: dict[bytes, tuple[int, ...]]  # word -> its places

    @property
    def enough(self) -> int:
        return math.ceil(COVERAGE * len(self.words))


def _template(name: str, text: str, must: str) -> Template:
    words = words_of(text)
    spare = len(words) - math.ceil(COVERAGE * len(words)) + 1
    often = Counter(words)
    places: dict[bytes, list[int]] = {}
    for i in sorted(range(len(words)), key=lambda i: (often[words[i]], -len(words[i]), i))[:spare]:
        places.setdefault(words[i], []).append(i)
    return Template(name, tuple(words), frozenset(words_of(must)), {w: tuple(p) for w, p in places.items()})


def templates(notices=NOTICES) -> list[Template]:
    return [_template(*n) for n in notices]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first number, in which the second increases."""
    ends, places, before = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(ends, b)
        before[i] = places[k - 1] if k else -1
        ends[k:k + 1], places[k:k + 1] = [b], [i]
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a, a_from: int, a_to: int, b, b_from: int, b_to: int) -> list[tuple[int, int]]:
    """Matched places of a[a_from:a_to] and b[b_from:b_to], in order."""
    found, todo = [], [(a_from, a_to, b_from, b_to)]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            found.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            found.append((hi, high))
        if lo >= hi or low >= high:
            continue
        once_a, once_b = Counter(a[lo:hi]), Counter(b[low:high])
        where = {b[j]: j for j in range(low, high) if once_b[b[j]] == 1}
        anchors = _increasing([(i, where[a[i]]) for i in range(lo, hi) if a[i] in where and once_a[a[i]] == 1])
        if anchors:
            found += anchors
            edges = [(lo - 1, low - 1), *anchors, (hi, high)]
            todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])]
    return sorted(found)


def find(text: str | None, known: list[Template]) -> list[tuple[str, int, int, int, int]]:
    """(name, first word, past last word, matched words, template words) of all notices in the text.
    Of notices that overlap the one with most matched and fewest other words stays, then the first."""
    words = words_of(text)
    telling = {w for t in known for w in t.telling}
    if telling.isdisjoint(words):
        return []
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in telling:
            at.setdefault(w, []).append(i)
    hits = set()
    for template in known:
        n = len(template.words)
        for word, places in template.telling.items():
            for i in at.get(word, ()):
                for j in places:
                    left = align(words, max(0, i - 2 * j - SLACK), i, template.words, 0, j)
                    right = align(words, i + 1, min(len(words), i + 1 + 2 * (n - j - 1) + SLACK), template.words, j + 1, n)
                    matched = [*left, (i, j), *right]
                    start, end = matched[0][0], matched[-1][0] + 1
                    if (len(matched) >= template.enough and end - start <= INSERTED * n
                            and template.must <= {template.words[y] for _, y in matched}):
                        hits.add((template.name, start, end, len(matched), n))
    # a word in the span that is not matched counts against the notice
    found: list[tuple[str, int, int, int, int]] = []
    ends, starts = [], []
    for hit in sorted(hits, key=lambda h: (h[2] - h[1] - 2 * h[3], h[1], h[2], h[0], h[4])):
        k = bisect_left(ends, hit[1] + 1)  # the first taken span that ends behind this one's start
        if k == len(starts) or starts[k] >= hit[2]:
            starts.insert(k, hit[1])
            ends.insert(k, hit[2])
            found.append(hit)
    return sorted(found, key=lambda f: f[1:])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """A row per notice found: doc_id, license, start_word, end_word, matched, template_words,
    coverage.  Null and empty texts have none; repeated rows give repeated notices."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(notices)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [(i, f) for i, t in enumerate(part.column(1).to_pylist()) for f in find(t, known)]
                columns = list(zip(*[f for _, f in found])) or [()] * 5
                yield pa.record_batch(
                    [part.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array(columns[0], pa.string()),
                     *[pa.array(columns[c], pa.int32()) for c in (1, 2, 3, 4)],
                     pa.array([m / n for m, n in zip(columns[3], columns[4])], pa.float64())],
                    names=["doc_id", "license", "start_word", "end_word", "matched", "template_words", "coverage"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, license string, start_word int, end_word int, matched int, "
                                "template_words int, coverage double")


ship(__name__)
