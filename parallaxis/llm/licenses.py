"""License scans: base phrases, and an exact set-similarity join of text blocks with notices.

A text's words stand in blocks that overlap by half: for a template of up to s words (s a power
of two) the blocks are the windows of 2s words at 0, s, 2s, ..., so whatever s words stand
together are whole in a block.  A block matches a template if it holds at least ``percent``
of the template's different words (containment).  Every such pair is found:

* Words are put in one global order, rarest first by their count over all documents.
* *Prefix*: a template that must share n of its m words shares one of its first m - n + 1 with
  the block, and so it is with the block's own first words.  Only these are looked up.
* *Length*: the block has at least n words of the templates.
* *Position*: with i and j words before the first shared one, at most min(m - i, b - j) are
  shared; a candidate with less goes.  Who is left is compared word by word.

Words that no template has can be shared with none, so a block's set is that of its template
words, and the global order is needed for these alone.

The templates are the join's small side: their index travels with the tasks, as large as the
templates are, whatever the corpus.  The documents are read twice, for the counts (a number
for each template word and task) and for the join, which has no shuffle.  A text is read in
pieces of a MB, and only template words are held, so memory follows these.

Null and empty texts have no words, no labels and score 0; null and repeated ids are rows like
others; texts of any length are read to their end.  Equal templates' blocks tie: both match.
An empty table has an empty result.  Only the id and the text are read, so no other column
can clash.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, slices, texts_of

PERCENT = 80

# The base phrases and their labels, fixed by the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their publishers word them (fixed values), by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the contract's class: every character beyond ASCII is bytes from 80
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER))


def hits(text: str | None, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The count of words, and places and numbers of those that ``number`` knows."""
    data = (text or "").encode().translate(_LOWER)
    n, at, places, known, start = 0, 0, [], [], 0
    while start < len(data):
        end = len(data)
        if end - start > PIECE and (cut := _BREAK.search(data, start + PIECE)):
            end = cut.start()
        words = _WORD.findall(data, start, end)
        v = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        there = np.flatnonzero(v >= 0)
        places.append(there + n)
        known.append(v[there])
        n, start = n + len(words), end
    none = np.zeros(0, np.int64)
    return n, np.concatenate([none, *places]), np.concatenate([none, *known])


class Index:
    """The templates in the global order of ``counts``, their prefixes, and the phrases."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], counts: dict[bytes, int], percent: int):
        sets = {label: frozenset(words_of(text)) for label, text in templates.items()}
        if any(not s for s in sets.values()):
            raise ValueError("a template needs words")
        own = {w for s in sets.values() for w in s} | {w for p in phrases for w in words_of(p)}
        self.number = {w: k for k, w in enumerate(sorted(own, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = {label: np.array(sorted(self.number[w] for w in s)) for label, s in sets.items()}
        self.need = {label: -(-len(s) * percent // 100) for label, s in sets.items()}
        self.phrases = [(np.array([self.number[w] for w in words_of(p)]), label) for p, label in phrases.items()]
        near = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * min(len(sets[a]), len(sets[b]))
        self.rivals = {a: {b for b in sets if a != b and near(a, b)} for a in sets}
        #: For each step its templates' prefixes: number -> (label, words before it).
        self.steps: dict[int, dict[int, list[tuple[str, int]]]] = {}
        for label, text in templates.items():
            step = 1 << max(4, (len(words_of(text)) - 1).bit_length())
            heads = self.steps.setdefault(step, {})
            for i, v in enumerate(self.sets[label][: len(self.sets[label]) - self.need[label] + 1]):
                heads.setdefault(int(v), []).append((label, i))

    def base(self, places: np.ndarray, known: np.ndarray) -> list[tuple[str, int]]:
        """``label, place`` of every phrase, by place."""
        found = []
        for words, label in self.phrases:
            m = len(words)
            if len(known) >= m:
                same = places[m - 1 :] - places[: len(places) - m + 1] == m - 1
                for k in range(m):
                    same &= known[k : len(known) - m + 1 + k] == words[k]
                found += [(label, int(p)) for p in places[np.flatnonzero(same)]]
        return sorted(found, key=lambda x: (x[1], x[0]))

    def blocks(self, n: int, places: np.ndarray, known: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """``label, start, end, shared, size`` of every block and template that match, by start."""
        found = []
        for step, heads in self.steps.items():
            hot = places[np.isin(known, np.fromiter(heads, np.int64, len(heads)))] // step
            for at in np.unique(np.concatenate([hot, hot[hot > 0] - 1])).tolist():
                start, end = at * step, min(n, at * step + 2 * step)
                low, high = np.searchsorted(places, [start, end])
                block = np.unique(known[low:high])
                seen = set()
                for j, v in enumerate(block.tolist()):
                    for label, i in heads.get(v, ()):
                        need, size = self.need[label], len(self.sets[label])
                        if label in seen or j > len(block) - need:  # beyond the block's prefix, or too short
                            continue
                        seen.add(label)  # the first shared word decides
                        if min(size - i, len(block) - j) < need:
                            continue
                        shared = len(np.intersect1d(block[j:], self.sets[label][i:], assume_unique=True))
                        if shared >= need:
                            found.append((label, start, end, shared, size))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def decided(self, found: list[tuple[str, int, int, int, int]]) -> list[bool]:
        """False for a match that overlaps one of a rival (a template of nearly the same words) that is better: higher containment, then more words."""
        best = [True] * len(found)
        for a, x in enumerate(found):
            b = a + 1
            while b < len(found) and found[b][1] < x[2]:
                y = found[b]
                if y[0] in self.rivals[x[0]]:
                    mine, theirs = (x[3] / x[4], x[4]), (y[3] / y[4], y[4])
                    best[a] &= mine >= theirs
                    best[b] &= theirs >= mine
                b += 1
        return best


def word_counts(docs: DataFrame, words: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of ``words`` stands in all texts: a row for each word, as many as the templates have."""
    number = {w: k for k, w in enumerate(words)}
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(hits(t.as_py(), number)[2], minlength=len(words))
        some = np.flatnonzero(total)
        yield batch_of(schema, some, total[some])

    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r["word"]]: r["n"] for r in counted.collect()}


FOUND = "doc_id long, n_words long, base array<struct<label: string, word: long>>, blocks array<struct<label: string, first: long, end: long, shared: long, size: long, best: boolean>>"


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``n_words``, the places of phrases (``base``) and every matching block.

    A block's ``best`` is false where an overlapping block matches a rival template better: such
    pairs meet the threshold too, and are left out of labels only.
    """
    words = sorted({w for text in [*templates.values(), *phrases] for w in words_of(text)})
    index = Index(templates, phrases, word_counts(docs, words, text_col), percent)
    phrase = pa.struct([("label", pa.string()), ("word", pa.int64())])
    block = pa.struct([("label", pa.string()), *[(c, pa.int64()) for c in ("first", "end", "shared", "size")], ("best", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(phrase)), ("blocks", pa.list_(block))])

    def run(batches):
        for b in slices(batches):
            counts, base, blocks = [], [], []
            for t in b.column(1):
                n, places, known = hits(t.as_py(), index.number)
                found = index.blocks(n, places, known)
                counts.append(n)
                base.append([{"label": label, "word": at} for label, at in index.base(places, known)])
                blocks.append([dict(zip(("label", "first", "end", "shared", "size", "best"), (*x, y), strict=True)) for x, y in zip(found, index.decided(found), strict=True)])
            yield batch_of(schema, b.column(0), counts, base, blocks)

    return texts_of(docs, id_col, text_col).mapInArrow(run, FOUND)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: a base phrase scores 1, else the best block's containment counts, else 0."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.filter("blocks", lambda b: b["best"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    share = F.array_max(F.transform(best, lambda b: b["shared"] / b["size"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", best["label"])).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
