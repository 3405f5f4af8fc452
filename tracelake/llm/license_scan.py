"""Licence scanning by a positional index of rare licence words.

Templates are licence notices, names and phrases. How many documents hold each template
word is counted over the whole corpus, which gives the words' inverse document
frequencies. A template's rarest words are its anchors, and the index lists for each word
the templates and places where it is one. A file's licence words are looked up from the
rarest down; an anchor at word i that stands at place p in a template points at a copy
that starts at i - p, and the postings of the template's other anchors must agree on that
start. A short template then has to stand there word for word; a long one has to have
MIN_SHARE of its words by weight near their places (up to a tenth of its length off, as
names are put in), and each of its mandatory key phrases word for word.

A text is read into licence word numbers, 2 bytes a word, in blocks, so that long texts
stay small. Only document frequencies are shuffled, at most one row a word and task.

Defined results: a null text has no words; rows that repeat are scanned one by one, and
count one by one in the frequencies; null ids are kept; without places, ``first_word`` and
``last_word`` are null, the labels empty and the score 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, quoted, utf8

# Phrases whose places are counted, with their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Further names, each found word for word.
NAMES = [
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("agpl", "gnu affero general public license"),
    ("gfdl", "gnu free documentation license"),
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "bsd license"),
    ("bsd-2-clause", "bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause license"),
    ("isc", "isc license"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal"),
]
# Notices as licences word them, each with the phrases that a copy must have.
NOTICES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", ("gnu lesser general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license version 2 0",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software",)),
]
#: Rarest distinct words of a notice that are anchors; of a phrase two.
NOTICE_ANCHORS, PHRASE_ANCHORS = 12, 2
#: Share of a notice's words, by weight, that a copy has; half of the anchors' weight makes a candidate.
MIN_SHARE = 0.6
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


#: Every word of the templates, numbered from 1; 0 is any other word.
VOCABULARY = {w: i for i, w in enumerate(sorted({w for _, t, *_ in [*BASE, *NAMES, *NOTICES] for w in words_of(t)}), 1)}
_NUMBERS = {w.encode(): i for w, i in VOCABULARY.items()}


class Template(NamedTuple):
    label: str
    words: np.ndarray
    base: bool
    keys: tuple[int, ...]  # phrases, by place among the templates; none for a phrase


def _numbers(text: str) -> np.ndarray:
    return np.array([VOCABULARY[w] for w in words_of(text)], np.int16)


PHRASES = [Template(a, _numbers(b), True, ()) for a, b in BASE] + [Template(a, _numbers(b), False, ()) for a, b in NAMES]
#: Key phrases are looked up as phrases are, but give no label by themselves.
_KEYS = sorted({k for _, _, keys in NOTICES for k in keys})
PHRASES += [Template("", _numbers(k), False, ()) for k in _KEYS]
TEMPLATES = PHRASES + [Template(a, _numbers(b), False, tuple(len(PHRASES) - len(_KEYS) + _KEYS.index(k) for k in keys)) for a, b, keys in NOTICES]


def word_numbers(raw: bytes | None) -> np.ndarray:
    """Licence word numbers of all words of a text (UTF-8)."""
    if not raw:
        return np.zeros(0, np.int16)
    raw, parts, at, get = raw.lower(), [], 0, _NUMBERS.get
    while at < len(raw):
        cut = _BREAK.search(raw, min(at + BLOCK, len(raw)))
        end = cut.start() if cut else len(raw)
        parts.append(np.array([get(w, 0) for w in _WORD.findall(raw, at, end)], np.int16))
        at = end
    return np.concatenate(parts)


class Index:
    """Anchors and their postings, from the corpus's document frequencies (by word number)."""

    def __init__(self, n_docs: int, frequencies: dict[int, int]):
        self.idf = np.array([0.0] + [math.log((n_docs + 1) / (frequencies.get(i, 0) + 0.5)) for i in range(1, len(VOCABULARY) + 1)])
        # by falling weight, then by word: places in this order are the words' ranks
        self.order = sorted(range(1, len(self.idf)), key=lambda i: (-self.idf[i], i))
        rank = {w: r for r, w in enumerate(self.order)}
        self.anchors: list[list[tuple[int, int]]] = []
        self.lookups: dict[int, list[int]] = {}
        for k, t in enumerate(TEMPLATES):
            rarest = sorted({int(w) for w in t.words}, key=rank.__getitem__)[: NOTICE_ANCHORS if t.keys else PHRASE_ANCHORS]
            first = [(w, int(np.flatnonzero(t.words == w)[0])) for w in rarest]
            self.anchors.append(first)
            # a phrase has all its anchors, so its rarest one finds every copy; of a notice any may be missing
            for w in rarest if t.keys else rarest[:1]:
                self.lookups.setdefault(w, []).append(k)

    def find(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(template, starts, their shares) for each template that the text holds."""
        present = np.bincount(ids, minlength=len(self.idf)) > 0
        places: dict[int, np.ndarray] = {}

        def at(w: int) -> np.ndarray:
            if w not in places:
                places[w] = np.flatnonzero(ids == w)
            return places[w]

        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pointed: dict[int, list[np.ndarray]] = {}
        for w in (w for w in self.order if present[w] and w in self.lookups):
            for k in self.lookups[w]:
                p = dict(self.anchors[k])[w]
                if TEMPLATES[k].keys:
                    pointed.setdefault(k, []).append(at(w) - p)
                    continue
                words = TEMPLATES[k].words
                starts = at(w) - p
                starts = starts[(starts >= 0) & (starts + len(words) <= len(ids))]
                for other, q in self.anchors[k]:
                    starts = starts[ids[starts + q] == other]
                for q, other in enumerate(words):
                    starts = starts[ids[starts + q] == other]
                if len(starts):
                    found[k] = starts, np.ones(len(starts))
        for k, starts in pointed.items():
            t = TEMPLATES[k]
            if not all(key in found for key in t.keys):
                continue
            near = np.unique(np.concatenate(starts))
            near = near[self._share(self.anchors[k], near, at, len(t.words)) >= 0.5]
            share = self._share([(int(w), q) for q, w in enumerate(t.words)], near, at, len(t.words))
            drift = max(2, len(t.words) // 10)
            ok = share >= MIN_SHARE
            for key in t.keys:
                ok &= _any_between(found[key][0], near - drift, near + len(t.words) + drift)
            if ok.any():
                near, share = near[ok], share[ok]
                # starts of one copy, which drift apart, count once: the best of them, then the first
                copies = np.split(np.arange(len(near)), np.flatnonzero(np.diff(near) > 2 * drift) + 1)
                best = [c[np.argmax(share[c])] for c in copies]
                found[k] = np.maximum(near[best], 0), share[best]
        return [(k, starts, shares) for k, (starts, shares) in found.items()]

    def _share(self, words: list[tuple[int, int]], starts: np.ndarray, at, length: int) -> np.ndarray:
        """By start: the share, by weight, of ``words`` (word, place) that stand near their places."""
        drift, got = max(2, length // 10), np.zeros(len(starts))
        for w, p in words:
            got += self.idf[w] * _any_between(at(w), starts + p - drift, starts + p + drift)
        return got / max(sum(self.idf[w] for w, _ in words), 1e-9)


def _any_between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Is one of the sorted ``places`` in [low, high]?"""
    return np.searchsorted(places, low, "left") < np.searchsorted(places, high, "right")


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[int, int]]:
    """Number of documents, and by licence word the number that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(VOCABULARY) + 1, np.int64)
        for batch in batches:
            for raw in utf8(batch.column(0)):
                ids = np.unique(word_numbers(raw))
                counts[ids[ids > 0]] += 1
            counts[0] += batch.num_rows  # the place of no word counts the documents
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["word", "n"])

    rows = map_slices(docs.select(F.col(quoted(text_col)).alias("text")), run, "word int, n long")
    counted = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counted.pop(0, 0), counted


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found), one row per row of ``docs``.

    The first four after the id are of the phrases in BASE. Labels are sorted arrays.
    ``score``: the highest share of a template, by weight, that the text holds. ``found``:
    structs (label, start, length, share), one per copy of a labelled template, by start.
    """
    n_docs, frequencies = document_frequencies(docs, text_col)
    index = Index(n_docs, frequencies)
    id_type = docs.select(F.col(quoted(id_col))).schema[0].dataType.simpleString()
    copy = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for raw in utf8(batch.column(1)):
                ids = word_numbers(raw)
                hits = [(TEMPLATES[k], starts, shares) for k, starts, shares in index.find(ids) if TEMPLATES[k].label]
                base = [(t.label, starts) for t, starts, _ in hits if t.base]
                row = (
                    len(ids), sum(len(s) for _, s in base), min((int(s[0]) for _, s in base), default=None), max((int(s[-1]) for _, s in base), default=None),
                    sorted({a for a, _ in base}), sorted({t.label for t, _, _ in hits}), max((float(s.max()) for *_, s in hits), default=0.0),
                    sorted(({"label": t.label, "start": int(s), "length": len(t.words), "share": float(c)} for t, starts, shares in hits for s, c in zip(starts, shares, strict=True)), key=lambda c: (c["start"], c["label"], c["length"])),
                )
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(copy)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"],
            )

    schema = (
        f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double, found array<struct<label:string,start:long,length:long,share:double>>"
    )
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)
