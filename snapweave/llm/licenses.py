"""Licence scans by a positional index of rare words.

Templates (notices, key sentences and whole texts of licences, the base phrases, and any more that are given) are indexed by word and position. A word weighs its
inverse document frequency, counted over all documents. Each template looks for its own heaviest words, so many that what is left of it
weighs less than ACCEPT: a place p of one that the template has at q gives the alignments from p - q - SLACK to p - q + SLACK, and no
other can be accepted. Each is compared word by word (a word may stand SLACK places off), and the best gives the score: the weight of
the template's words found in place over that of all. A template counts if its score reaches ACCEPT and each of its mandatory
key phrases stands in the file. A base phrase counts wherever its
words stand in a row.

Defined cases: a null or empty text has no words, no labels and score 0; rows are judged one by one, so repeated rows get equal results; a text
of any length is one value, scanned whole; columns other than doc_id and text aren't read, whatever their names; an empty table gives an empty result. Counts are of all rows, and only the words of templates are counted.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, text and mandatory key phrases of each template: notices and key sentences as their licences give them (fixed values).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org licenses license 2 0", ("apache org licenses",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is"
        " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or"
        " copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "included in all copies or substantial portions"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for"
        " any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or"
        " in connection with the use or performance of this software",
        ("with or without fee is hereby granted", "the author disclaims all warranties"),
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"
        " this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or"
        " other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
        " prior written permission",
        ("redistributions of source code must retain", "to endorse or promote products derived from this software"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use"
        " this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must"
        " not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly"
        " marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ("the origin of this software must not be misrepresented",),
    ),
)

SLACK = 2
ACCEPT = 0.7
#: Words too common in any text to be looked up (fixed values); they still count in a comparison.
COMMON = frozenset(b"a all and any are as at be by can for free from has have in is it its may not of on or that the this to use v with you 0 1 2 3 4".split())

_PLAIN = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in _PLAIN)


def split(text: str | None) -> list[bytes]:
    """Words of a text: letters, digits and all that isn't ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    base: bool


More = tuple[tuple[str, str, tuple[str, ...]], ...]


def templates(more: More = ()) -> list[Template]:
    """The base phrases, the templates and more of them: label, text of any length, and mandatory key phrases."""
    out = [Template(label, split(phrase), [split(phrase)], True) for phrase, label in PHRASES.items()]
    return out + [Template(label, split(text), [split(k) for k in keys], False) for label, text, keys in (*TEMPLATES, *more)]


class Index:
    """The templates with the weights of their words, and the positions that each is looked for by."""

    def __init__(self, found: dict[bytes, int], documents: int, more: More = ()):
        self.templates = templates(more)
        for t in self.templates:
            for words in (t.words, *t.keys):
                assert any(w not in COMMON for w in words), words
        vocabulary = {w for t in self.templates for w in t.words}
        self.weight = {w: math.log((documents + 1) / (found.get(w, 0) + 0.5)) + 1 for w in vocabulary}
        self.weight = {w: max(x, 0.1) for w, x in self.weight.items()}
        self.rare = frozenset(vocabulary) - COMMON
        self.total = [sum(self.weight[w] for w in t.words) for t in self.templates]
        self.pivots = [self.heaviest(t, total) for t, total in zip(self.templates, self.total, strict=True)]
        self.rare |= {t.words[q] for t, pivots in zip(self.templates, self.pivots, strict=True) for q in pivots}

    def heaviest(self, template: Template, total: float) -> list[int]:
        """Positions of a template of which one at least is in place where the score reaches ACCEPT."""
        out, held = [], 0.0
        for q in sorted(range(len(template.words)), key=lambda q: (template.words[q] not in self.rare, -self.weight[template.words[q]], q)):
            out.append(q)
            held += self.weight[template.words[q]]
            if held > (1 - ACCEPT) * total + 1e-9:
                break
        return out

    def places(self, words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
        """Where the words of a phrase stand in a row, by its heaviest word that isn't common."""
        i = max((k for k, w in enumerate(phrase) if w in self.rare), key=lambda k: self.weight[phrase[k]])
        return [p - i for p in where.get(phrase[i], ()) if p >= i and words[p - i : p - i + len(phrase)] == phrase]

    def compare(self, words: list[bytes], template: Template, total: float, start: int) -> float:
        """Weight of the template's words that stand in place, in order, from start on; 0 once it can't be accepted."""
        at, got, spare = start - SLACK - 1, 0.0, (1 - ACCEPT) * total + 1e-9
        for q, w in enumerate(template.words):
            lo = max(at + 1, start + q - SLACK, 0)
            hi = min(start + q + SLACK + 1, len(words))
            for p in range(lo, hi):
                if words[p] == w:
                    at, got = p, got + self.weight[w]
                    break
            else:
                spare -= self.weight[w]
                if spare < 0:
                    return 0.0
        return got

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = split(text)
        present = self.rare.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        where: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in present:
                where[w].append(p)
        base, starts, labels, score = set(), [], set(), 0.0
        for i, t in enumerate(self.templates):
            if t.base:
                # a base phrase is looked for by its own heaviest word, among all words of the file
                found = self.places(words, where, t.words)
                if found:
                    base.add(t.label)
                    starts += found
                    score = 1.0
            elif all(self.places(words, where, k) for k in t.keys):
                near = {p - q + d for q in self.pivots[i] for p in where.get(t.words[q], ()) for d in range(-SLACK, SLACK + 1)}
                got = max((self.compare(words, t, self.total[i], start) for start in near), default=0.0) / self.total[i]
                if got >= ACCEPT:
                    labels.add(t.label)
                    score = max(score, min(got, 1.0))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def frequencies(docs: DataFrame, more: More = ()) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and the number of documents: a few hundred rows."""
    vocabulary = frozenset(w for t in templates(more) for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(vocabulary.intersection(split(text)))
                n += 1
        rows = [("", n), *((w.decode(), c) for w, c in sorted(found.items()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows if r.word}, sum(r.n for r in rows if not r.word)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, more: More = ()) -> DataFrame:
    """Of each row of docs: words, places of base phrases, labels and score; more are templates beside those of this module."""
    sent = docs.sparkSession.sparkContext.broadcast((*frequencies(docs, more), more))  # a number for each word of the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            out = [index.scan(text) for text in batch.column("text").to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _OUT)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
