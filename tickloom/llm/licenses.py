"""License scans: an exact set-similarity join of text blocks with license templates.

A block is ``BLOCK`` words, a new one every ``STRIDE``, so that whatever is up to STRIDE + 1 words long lies inside one. Longer
templates have blocks of their own, as far apart as they are long less a word, and twice that wide. A template T is found in
a block B if |B & T| >= threshold * |T| = o over distinct words. Words of templates are ordered by how many documents hold
them, rarest first, and both sets by that order; other words count for nothing. A block that reaches o must have o words
(length filter), one of its first |B| - o + 1 words must be one of T's first |T| - o + 1 (prefix filter), and where they meet,
at places j and i, the words met before and those left, min(|T| - i, |B| - j), must reach o (positional filter).
Templates are few and fixed, so their index is sent to every task and documents never move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, worker

BLOCK, STRIDE, THRESHOLD = 64, 32, 0.85

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings, conditions and disclaimers of well-known public license notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness"),
    ("mpl", "Covered Software is provided under this License on an as is basis, without warranty of any kind, either expressed, implied, or statutory"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8; all separators are ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of all places where the phrase's words stand consecutively."""
    out, at, k = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[-1], at + 1)
        except ValueError:
            return out
        if at - k + 1 >= 0 and words[at - k + 1 : at + 1] == phrase:
            out.append(at - k + 1)


class TemplateIndex:
    """Templates as sets of ranks in a global order of words, with postings of their prefixes."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float) -> None:
        vocabulary = {w for _, text in templates for w in words_of(text)}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [(label, sorted({self.rank[w] for w in words_of(text)})) for label, text in templates]
        self.need = [ceil(threshold * len(t) - 1e-9) for _, t in self.sets]
        #: Postings by the stride of their templates' blocks.
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, ((_, t), (_, text)) in enumerate(zip(self.sets, templates, strict=True)):
            mine = self.postings.setdefault(max(STRIDE, len(words_of(text)) - 1), {})
            for i, r in enumerate(t[: len(t) - self.need[k] + 1]):
                mine.setdefault(r, []).append((k, i))
        self.whole = [frozenset(t) for _, t in self.sets]
        self.least = {stride: min(self.need[k] for rows in mine.values() for k, _ in rows) for stride, mine in self.postings.items() if mine}

    def find(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """Every (start of block, label, containment) at or above the threshold, for all templates."""
        ranks = list(map(self.rank.get, words))
        held = set(ranks)
        out = []
        for stride in sorted(self.least):
            if not held.isdisjoint(self.postings[stride]):
                out += self._find(ranks, stride, BLOCK if stride == STRIDE else 2 * stride)
        return sorted(out, key=lambda b: b[0]) if len(self.postings) > 1 else out

    def filtered(self, block: list[int], stride: int) -> list[int]:
        """The templates that pass all filters in a block's sorted ranks."""
        postings, least, n = self.postings[stride], self.least[stride], len(block)
        met: dict[int, int] = {}
        for j, r in enumerate(block[: max(0, n - least + 1)]):
            for k, i in postings.get(r, ()):
                need, before = self.need[k], met.get(k, 0)
                if before < 0 or j > n - need:
                    continue
                met[k] = before + 1 if before + min(len(self.sets[k][1]) - i, n - j) >= need else -1
        return [k for k, c in met.items() if c > 0]

    def _find(self, ranks: list[int | None], stride: int, width: int) -> list[tuple[int, str, float]]:
        """The finds of templates whose blocks are ``stride`` words apart."""
        postings = self.postings[stride]
        starts = set()
        for i, r in enumerate(ranks):
            if r in postings:
                starts.update(range(max(0, (i - width) // stride + 1) * stride, i + 1, stride))
        out = []
        for s in sorted(starts):
            block = frozenset(ranks[s : s + width]) - {None}
            if len(block) < self.least[stride]:
                continue
            for k in sorted(self.filtered(sorted(block), stride)):
                common = len(block & self.whole[k])
                if common >= self.need[k]:
                    out.append((s, self.sets[k][0], common / len(self.whole[k])))
        return out


def _counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the templates stands: a row for each such word."""

    def run(batches):
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                got.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["w", "c"])

    rows = docs.mapInArrow(worker(run), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
    return {bytes(r["w"]): r["c"] for r in rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: its id, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (their least and greatest
    start, else null), ``base_labels``, ``labels`` (with those of templates; distinct, sorted, comma-joined), ``score`` (1.0 for a
    phrase, else the largest containment found, else 0.0) and ``blocks`` (start, label, containment of each find).

    A null or empty text has no words and no labels. Repeated rows and null ids keep their rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    sought = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))
    index = TemplateIndex(templates, _counts(base.select("_text"), vocabulary), threshold)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    kinds.append(("blocks", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))))

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        at, named = [], set()
        for phrase, label in sought:
            got = places(words, phrase)
            if got:
                at += got
                named.add(label)
        blocks = index.find(words)
        score = 1.0 if at else max((b[2] for b in blocks), default=0.0)
        return (
            len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named)),
            ",".join(sorted(named | {b[1] for b in blocks})), score, [dict(zip(("start", "label", "containment"), b, strict=True)) for b in blocks],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(scan, b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True))], names=["_id", *(n for n, _ in kinds)])

    kind = base.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start: long, label: string, containment: double>>"
    return base.mapInArrow(worker(run), schema).withColumnRenamed("_id", id_col)
