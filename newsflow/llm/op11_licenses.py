"""License scan by diagonal voting (operator 11).

Words are lower-cased runs of digits, letters and non-ASCII characters.  Templates are license texts, notices and short
phrases.

1. Every ``k``-gram of words of every text is hashed and joined by Spark to the k-grams of the templates; ``k`` is ``GRAM``, or a
   template's length if that is less, so phrases are found whole.
2. A match of a text's word ``p`` and a template's word ``t`` votes for the diagonal ``p - t``.  Votes of a text, a template and a
   diagonal add up.
3. Diagonals at most ``DRIFT`` words apart are neighbours and are merged: words put in or left out shift a copy a little.
4. A merged group's span of the text is verified: its words and the template's are compared, and the share of the template
   that stands in it in order is the span's score; it must be ``VERIFIED`` or more.  A template of fewer than ``SHORT`` words must
   stand whole and unbroken.  Of spans that lie on each other, the one with most words of its template gives the label.

Places of a base phrase are the verified spans of its template, each on its own diagonal.

The template table is broadcast: ``MAX_GRAMS`` entries at most, checked.  Texts meet their votes by an equi-join; only votes are
shuffled, and texts where the votes are too many for a broadcast.

Defined cases: a null or empty text has no words and no label; rows with equal id and text have equal results; a null id is kept;
an empty table gives an empty result; a phrase counts at every place, a label once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

GRAM = 4
DRIFT = 3
VERIFIED = 0.8
SHORT = 12
MAX_GRAMS = 1_000_000
NO_ID = -(1 << 63)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)
SPAN = "array<struct<template:string,label:string,start:int,words:int,share:double>>"


@dataclass(frozen=True)
class Template:
    """``base`` phrases count at every place; ``name`` tells templates of one label apart."""

    name: str
    label: str
    text: str
    base: bool = False


# fixed values: base phrases and their labels
BASE = (
    Template("phrase: mit", "mit", "mit license", True),
    Template("phrase: apache", "apache", "apache license", True),
    Template("phrase: gpl", "gpl", "general public license", True),
)

# fixed values: short notices and the opening or operative parts of public licenses
NOTICES = (
    Template("notice: mit", "mit", "released under the mit license"),
    Template("notice: apache 2", "apache-2.0", "licensed under the apache license, version 2.0"),
    Template("notice: gpl 3", "gpl-3.0", "licensed under the gnu general public license, version 3"),
    Template("notice: gpl 2", "gpl-2.0", "licensed under the gnu general public license, version 2"),
    Template("notice: lgpl", "lgpl", "licensed under the gnu lesser general public license"),
    Template("notice: agpl", "agpl", "licensed under the gnu affero general public license"),
    Template("notice: cc by", "cc-by-4.0", "licensed under cc by 4.0"),
    Template("notice: cc by-sa", "cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    Template("notice: cc by-nc", "cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    Template("notice: cc by-nd", "cc-by-nd-4.0", "licensed under cc by-nd 4.0"),
    Template("notice: mpl", "mpl-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    Template("deed: cc by", "cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    Template("deed: cc by-sa", "cc-by-sa-4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    Template("deed: cc by-nc", "cc-by-nc-4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    Template("text: mit", "mit", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.")),
    Template("text: isc", "isc", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.")),
    Template("text: bsd", "bsd", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.")),
    Template("text: apache 2", "apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.")),
    Template("text: gpl 3", "gpl-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    Template("text: gpl 2", "gpl-2.0", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")),
    Template("text: mpl", "mpl-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")),
    Template("text: unlicense", "unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.")),
)

TEMPLATES = BASE + NOTICES


class Words:
    """Word bounds and hashes of a slice."""

    def __init__(self, s: tb.Slice):
        self.start, self.end, self.first = tb.runs(s, tb.ALNUM)
        self.h = tb.hashes(s, self.start, self.end)


def _slices(texts: pa.Array) -> Iterator[tb.Slice]:
    return tb.slices(texts, tb.LOWER)


class Bank:
    """The templates' words, gram sizes and gram table."""

    def __init__(self, templates: Sequence[Template], gram: int = GRAM):
        if len({t.name for t in templates}) < len(templates):
            raise ValueError("templates need names of their own")
        self.templates = templates
        self.words, self.raw, self.k, self.rows = [], [], [], []
        for n, t in enumerate(templates):
            for s in _slices(pa.array([t.text])):
                w = Words(s)
                self.words.append(w.h)
                self.raw.append([s.raw(a, z) for a, z in zip(w.start.tolist(), w.end.tolist(), strict=True)])
                k = min(gram, len(w.h))
                self.k.append(k)
                if k:
                    h, at = tb.windows(w.h, w.first, k)
                    self.rows += [(int(x), n, int(p)) for x, p in zip(_salted(h, k), at, strict=True)]
        self.sizes = sorted({k for k in self.k if k})
        if len(self.rows) > MAX_GRAMS:
            raise ValueError(f"{len(self.rows)} grams of templates; at most {MAX_GRAMS} are broadcast")


def _salted(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k-grams, apart from those of other sizes."""
    return tb.mix(h + np.uint64(k)).view(np.int64)


def grams(docs: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(h, id, key, p): all rolling grams of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in _slices(b.column(2)):
                w = Words(s)
                row = tb.row_of(w.first)
                for k in sizes:
                    h, at = tb.windows(w.h, w.first, k)
                    r = row[at]
                    yield tables.record([
                        ("h", pa.int64(), _salted(h, k)), ("id", pa.int64(), ids[r + s.lo]), ("key", pa.int64(), keys[r + s.lo]),
                        ("p", pa.int32(), (at - w.first[r]).astype(np.int32))])

    return docs.mapInArrow(work, "h long, id long, key long, p int")


def votes(docs: DataFrame, bank: Bank) -> DataFrame:
    """(id, key, template, diagonal, votes, low, high): the template words met on each diagonal, from low to high."""
    table = docs.sparkSession.createDataFrame(bank.rows or [(0, 0, 0)], "h long, template int, t int")
    met = grams(docs, bank.sizes).join(F.broadcast(table), "h")
    return met.groupBy("id", "key", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("t").alias("low"), F.max("t").alias("high"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), tables.text_key(body).alias("key"), body.alias("text"))


def neighbours(diagonals: list[tuple[int, int, int, int]], drift: int = DRIFT) -> list[tuple[int, int, int]]:
    """(first, last place of the text, votes) of groups of neighbouring diagonals, from (diagonal, low, high, votes) in order."""
    out: list[list[int]] = []
    before = None
    for d, low, high, n in diagonals:
        if before is None or d - before > drift:
            out.append([d + low, d + high, n])
        else:
            a, z, m = out[-1]
            out[-1] = [min(a, d + low), max(z, d + high), m + n]
        before = d
    return [(a, z, n) for a, z, n in out]


def common(a: list[bytes], b: list[bytes], band: int) -> int:
    """Length of the longest common subsequence whose places differ by at most ``band``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        lo, hi = min(max(0, i - band), len(b)), min(len(b), i + band + 1)
        corner = left = row[lo]
        for j in range(lo, hi):
            up = row[j + 1]
            left = max(left, up, corner + 1 if x == b[j] else 0)
            corner, row[j + 1] = up, left
    return max(row)


class Scan:
    """Verifies the spans of one text."""

    def __init__(self, bank: Bank):
        self.bank = bank

    def spans(self, s: tb.Slice, w: Words, r: int, met: list[dict]) -> list[tuple[int, int, int, float]]:
        """(template, first word, number of words, share of the template) of verified spans."""
        lo, n_words = int(w.first[r]), int(w.first[r + 1] - w.first[r])

        def words(a: int, z: int) -> list[bytes]:
            return [s.raw(int(w.start[lo + i]), int(w.end[lo + i])) for i in range(a, z)]

        by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for x in met:
            by[x["template"]].append((x["diagonal"], x["low"], x["high"], x["votes"]))
        out = []
        for n, diagonals in sorted(by.items()):
            k, raw = self.bank.k[n], self.bank.raw[n]
            size = len(raw)
            if size < SHORT:  # every diagonal is a place
                places = [d for d, *_ in sorted(diagonals) if 0 <= d <= n_words - size]
                out += [(n, d, size, 1.0) for d in places if words(d, d + size) == raw]
                continue
            # a changed word takes k grams at most
            least = (size - k + 1) - k * (1 - VERIFIED) * size
            for a, z, n_votes in neighbours(sorted(diagonals)):
                if n_votes < least:
                    continue
                low, high = max(0, z + k - size - DRIFT), min(n_words, a + size + DRIFT)
                low, high = min(low, a), max(high, min(z + k, n_words))
                share, begin, end = _best(words(low, high), raw)
                if share >= VERIFIED:
                    out.append((n, low + begin, end - begin, share))
        return self._settled(out)

    def _settled(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Without spans that lie mostly on one of another label with more words of its template."""
        def strength(x: tuple[int, int, int, float]) -> tuple:
            return -round(x[3] * len(self.bank.raw[x[0]])), -x[3], x

        out = [x for x in spans if self.bank.templates[x[0]].base]
        held: dict[int, str] = {}  # the label of every word of a kept span
        for x in sorted((x for x in spans if not self.bank.templates[x[0]].base), key=strength):
            n, a, size, _ = x
            label = self.bank.templates[n].label
            if 2 * sum(held.get(i, label) != label for i in range(a, a + size)) <= size:
                out.append(x)
                held.update((i, label) for i in range(a, a + size) if i not in held)
        return sorted(out)


def _best(words: list[bytes], raw: list[bytes]) -> tuple[float, int, int]:
    """(share of the template, from, to) of the part of ``words`` that holds most of it in order."""
    n, step = len(raw), max(1, len(raw) // 4)
    best = (0.0, 0, 0)
    for at in range(0, max(1, len(words) - n // 2), step):
        part = words[at: at + n + step + 2 * DRIFT]
        share = common(part, raw, step + 2 * DRIFT) / n
        if share > best[0]:
            best = (share, at, min(len(words), at + len(part)))
    return best


def scanned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES,
) -> DataFrame:
    """(doc_id, n_words, spans) of every row: each verified span with its template, label, place and share."""
    bank = Bank(templates)
    keyed = _keyed(docs, doc_id, text)
    met = votes(keyed, bank).groupBy("id", "key").agg(
        F.collect_list(F.struct("template", "diagonal", "low", "high", "votes")).alias("met"))
    met = tables.stored(met, "license-votes")
    scan = Scan(bank)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for s in _slices(b.column(1)):
                w = Words(s)
                found = []
                for r, m in enumerate(b.column(2).slice(s.lo, s.rows).to_pylist()):
                    found.append([
                        {"template": templates[n].name, "label": templates[n].label, "start": a, "words": k, "share": x}
                        for n, a, k, x in scan.spans(s, w, r, m)] if m else [])
                kind = pa.list_(pa.struct([
                    ("template", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("share", pa.float64())]))
                yield tables.record([
                    ("doc_id", pa.int64(), ids.slice(s.lo, s.rows)), ("n_words", pa.int64(), np.diff(w.first)), ("spans", kind, found)])

    rows = keyed.join(met, ["id", "key"], "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "met")
    return rows.mapInArrow(work, f"doc_id long, n_words long, spans {SPAN}")


def _joined(labels) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t.name) for t in BASE])
    rows = scanned(tables.read(spark, sf_dir, "documents")).withColumn(
        "base", F.filter("spans", lambda x: F.array_contains(names, x["template"])))
    places = F.transform("base", lambda x: x["start"].cast("long"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.col("spans.label")).alias("labels"), F.coalesce(F.array_max("spans.share"), F.lit(0.0)).alias("score"))
