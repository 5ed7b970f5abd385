"""Licences in texts by a positional index of rare words.

The known licences are templates: short public notices and the grants of longer texts, a
fixed set. An index holds for each of their words the templates and positions where it
stands (its postings). A first pass counts in how many documents each of these words occurs,
which gives their inverse document frequencies. Then, for each file and each template,

1. the words of the template that the file has are looked up from the highest IDF down, up to
   ``LOOKED_UP`` of them (equal ones by code point);
2. their postings are intersected by relative position: a place in the file less the
   position in the template is where the template would begin, the same for all words of
   a copy, whatever stands around it. Beginnings are collected in bands of ``BAND`` words (in
   two layouts that overlap by half), so that some words put in or left out do no harm. A
   band with half as many different words as may be looked up is a candidate;
3. a candidate is verified: each mandatory phrase of the template must stand in the file
   where the template would, and at least half of the template's words, too.

Beside the templates there are base phrases, found wherever their words stand one after the other.
The score is 0 without any of it, 0.5 for a file that only names a licence by a base phrase, and
0.5 to 1 for a file with a template: half of 1 plus the best share of words found.

The index is that of the templates and is of a fixed size whatever the corpus; documents are read
whole by their own task, texts beyond ``BATCH_BYTES`` in pieces, of which one number a word is kept.

Defined cases: null and empty texts have no words, no place and no label (the empty string),
score 0; places of a phrase that overlap count each; ties of the best share are equal scores;
repeated rows are rows of their own and count as documents in the frequencies; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read, so extra columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.llm.words import texts_of, xxh64

#: A word of a text in which A-Z is lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP = 12
BAND = 16
LEAST_SHARE = 0.5
#: Bytes of text handled at once.
BATCH_BYTES = 2_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The phrases that are always reported, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
        ("mit license", "mit"))

# Label, wording and mandatory phrases of the licences' public notices.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
      software and associated documentation files (the "Software"), to deal in the Software
      without restriction, including without limitation the rights to use, copy, modify, merge,
      publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
      to whom the Software is furnished to do so, subject to the following conditions: The above
      copyright notice and this permission notice shall be included in all copies or substantial
      portions of the Software.""",
     ("permission is hereby granted free of charge", "this permission notice shall be included")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0",
     ("apache license version 2 0",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
      this file except in compliance with the License. You may obtain a copy of the License at
      http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
      in writing, software distributed under the License is distributed on an "AS IS" BASIS,
      WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
     ("apache license version 2 0", "in compliance with the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
     ("gnu general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
     ("gnu general public license version 2",)),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the
      terms of the GNU General Public License as published by the Free Software Foundation;
      either version 2 of the License, or (at your option) any later version.""",
     ("gnu general public license as published", "either version 2 of the license")),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the
      terms of the GNU General Public License as published by the Free Software Foundation,
      either version 3 of the License, or (at your option) any later version.""",
     ("gnu general public license as published", "either version 3 of the license")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the
      terms of the GNU Lesser General Public License as published by the Free Software
      Foundation; either version 2.1 of the License, or (at your option) any later version.""",
     ("gnu lesser general public license as published",)),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the
      terms of the GNU Affero General Public License as published by the Free Software
      Foundation, either version 3 of the License, or (at your option) any later version.""",
     ("gnu affero general public license as published",)),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License,
      v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
      http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0",)),
    ("epl-2.0", """This program and the accompanying materials are made available under the terms of
      the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
     ("eclipse public license 2 0",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are
      permitted provided that the following conditions are met: Redistributions of source code
      must retain the above copyright notice, this list of conditions and the following
      disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
      list of conditions and the following disclaimer in the documentation and/or other materials
      provided with the distribution.""",
     ("redistribution and use in source and binary forms", "in binary form must reproduce")),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors
      may be used to endorse or promote products derived from this software without specific
      prior written permission.""",
     ("neither the name of", "endorse or promote products derived from this software")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with
      or without fee is hereby granted, provided that the above copyright notice and this
      permission notice appear in all copies.""",
     ("with or without fee is hereby granted", "this permission notice appear in all copies")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no
      event will the authors be held liable for any damages arising from the use of this
      software. Permission is granted to anyone to use this software for any purpose, including
      commercial applications, and to alter it and redistribute it freely""",
     ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone
      is free to copy, modify, publish, use, compile, sell, or distribute this software""",
     ("free and unencumbered software released into the public domain",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related"
     " or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
)


def words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, UPPER.lower())))


def _lowered() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every byte, and whether a lowered byte belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    inside = np.zeros(256, bool)
    inside[ord("0"):ord("9") + 1] = inside[ord("a"):ord("z") + 1] = inside[0x80:] = True
    return lower, inside


LOWER, INSIDE = _lowered()


@dataclass
class Template:
    label: str
    words: np.ndarray
    phrases: list[np.ndarray]

    def __post_init__(self):
        self.own, self.times = np.unique(self.words, return_counts=True)
        self.needed = -(-min(LOOKED_UP, len(self.own)) // 2)
        self.mandatory = np.unique(np.concatenate(self.phrases))
        # postings: positions by word, those of own[i] are at[starts[i]:starts[i] + times[i]]
        self.at = np.argsort(self.words, kind="stable")
        self.starts = np.cumsum(self.times) - self.times


class Index:
    """The templates' words, numbered by code point, with their postings."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [w for _, text, phrases in templates for part in (text, *phrases) for w in words(part)]
        self.vocabulary = sorted({*texts, *(w for phrase, _ in base for w in words(phrase))})
        number = {w: i for i, w in enumerate(self.vocabulary)}

        def ids(text: str) -> np.ndarray:
            return np.array([number[w] for w in words(text)], np.int32)
        self.templates = [Template(label, ids(text), [ids(p) for p in phrases])
                          for label, text, phrases in templates]
        self.base = [(ids(phrase), label) for phrase, label in base]
        coded = [w.encode() for w in self.vocabulary]
        ends = np.cumsum([len(w) for w in coded])
        hashes = xxh64(np.frombuffer(b"".join(coded) + bytes(8), np.uint8).copy(),
                       ends - [len(w) for w in coded], ends)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        #: Which lengths and first bytes the words have; others need no hash.
        self.shapes = np.zeros((max(map(len, coded)) + 2, 256), bool)
        for w in coded:
            self.shapes[len(w), w[0]] = True

    def _ids(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word (-1: of no template) and its first byte's place."""
        raw = LOWER[raw]
        inside = INSIDE[raw]
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        out = np.full(len(starts), -1, np.int32)
        size = np.minimum(ends - starts, len(self.shapes) - 1)
        may = np.flatnonzero(self.shapes[size, raw[starts]]) if len(starts) else starts
        if len(may):
            hashes = xxh64(np.concatenate([raw, np.zeros(8, np.uint8)]), starts[may], ends[may])
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out[may] = np.where(self.hashes[at] == hashes, self.by_hash[at], -1)
        return out, starts

    def _long(self, text: bytes) -> np.ndarray:
        """The numbers of a long text, piece by piece; a piece ends between two words."""
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + BATCH_BYTES)
            while end < len(text) and INSIDE[LOWER[text[end]]] and INSIDE[LOWER[text[end - 1]]]:
                end += 1
            parts.append(self._ids(np.frombuffer(text[at:end], np.uint8))[0])
            at = end
        return np.concatenate(parts)

    def read(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' words as numbers, many short texts at a time: ``ids, offsets``."""
        held: list[bytes] = []
        size = 0

        def flush() -> tuple[np.ndarray, np.ndarray]:
            ids, starts = self._ids(np.frombuffer(b"\n".join(held), np.uint8))
            cuts = np.cumsum([len(t) + 1 for t in held])
            return ids, np.concatenate([[0], np.searchsorted(starts, cuts)])
        for text in texts:
            text = text or b""
            if held and size + len(text) > BATCH_BYTES:
                yield flush()
                held, size = [], 0
            if len(text) > BATCH_BYTES:
                ids = self._long(text)
                yield ids, np.array([0, len(ids)])
            else:
                held.append(text)
                size += len(text) + 1
        if held:
            yield flush()


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where a phrase begins."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for i, w in enumerate(phrase[1:], 1):
        at = at[ids[at + i] == w]
    return at


def match(ids: np.ndarray, template: Template, rarity: np.ndarray) -> float:
    """The best share of a template's words at a verified place of a file, 0 without one.

    ``rarity`` is the place of each word in the order from the highest IDF down.
    """
    has = np.intersect1d(ids, template.own)
    looked = has[np.argsort(rarity[has])[:LOOKED_UP]]
    if len(looked) < template.needed:
        return 0.0
    at = np.flatnonzero(np.isin(ids, looked))
    own = np.searchsorted(template.own, ids[at])
    times = template.times[own]
    # each place with each posting of its word
    which = np.repeat(np.arange(len(at)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    begins = at[which] - template.at[template.starts[own[which]] + nth]
    best, length = 0.0, len(template.words)
    for shift in (0, BAND // 2):
        pairs = np.unique(((begins + shift) // BAND + length) * len(template.own) + own[which])
        bands, counts = np.unique(pairs // len(template.own), return_counts=True)
        for band in bands[counts >= template.needed]:
            first = int(band - length) * BAND - shift
            part = ids[max(0, first):max(0, first + BAND - 1 + length)]
            share = np.minimum(np.bincount(part[part >= 0], minlength=len(rarity))[template.own],
                               template.times).sum() / length
            if share > best and share >= LEAST_SHARE and all(
                    len(places(part, p)) for p in template.phrases):
                best = float(share)
    return best


def _counter(index: Index):
    """Documents in which each word occurs; the last row of a task, with no word, counts all."""
    def run(tables):
        n = len(index.vocabulary)
        counts, documents = np.zeros(n, np.int64), 0
        for rows in tables:
            for ids, offsets in index.read(texts_of(rows)):
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                known = ids >= 0
                counts += np.bincount(np.unique(of[known] * n + ids[known]) % n, minlength=n)
                documents += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(counts)],
                                         ["word", "documents"])
    return run


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """The number of documents with each word of the templates."""
    rows = (docs.select("text").mapInArrow(_counter(index), "word int, documents long")
            .groupBy("word").agg(F.sum("documents").alias("documents")).collect())  # the templates' words
    out = np.zeros(len(index.vocabulary), np.int64)
    for r in rows:
        out[r["word"]] = r["documents"]
    return out


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string,"
          " labels string, score double")


def judge(ids: np.ndarray, index: Index, rarity: np.ndarray) -> tuple:
    """The columns of ``RESULT`` for a file."""
    found, base, best = [], set(), 0.0
    for phrase, label in index.base:
        at = places(ids, phrase)
        if len(at):
            found.append(at)
            base.add(label)
    labels = set(base)
    has = np.zeros(len(rarity), bool)
    has[ids[ids >= 0]] = True
    for template in index.templates:
        if has[template.mandatory].all() and has[template.own].sum() >= template.needed:
            share = match(ids, template, rarity)
            if share:
                labels.add(template.label)
                best = max(best, share)
    score = 0.5 + 0.5 * best if labels else 0.0
    return (len(ids), sum(map(len, found)), min((int(p[0]) for p in found), default=None),
            max((int(p[-1]) for p in found), default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score)


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT`` of every document."""
    index = index or Index()
    # the highest IDF is the smallest number of documents; ties by code point
    rarity = np.empty(len(index.vocabulary), np.int64)
    rarity[np.argsort(frequencies(docs, index), kind="stable")] = np.arange(len(rarity))

    def run(tables):
        for rows in tables:
            out = [judge(ids[a:b], index, rarity) for ids, offsets in index.read(texts_of(rows))
                   for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * 7
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", *(f.split()[0] for f in RESULT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")
