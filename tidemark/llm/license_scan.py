"""Licence notices in documents, by a positional index of rare words.

The index holds licence templates and key phrases: for each word, in which template and at which place
it stands.  Words are weighed by inverse document frequency over all documents.  Of each template the
highest-weighing words are its anchors, as many as it takes that a match without any of them could
not reach the template's required share; so looking up a file's anchors misses no match.

An anchor at place p of the file that stands at place q of a template votes for the alignment p - q.  Each
alignment is verified word by word: the matching words' share of the template's weight, and that the
template's mandatory key phrase stands inside.  Key phrases are templates that must match whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, identified, pieces, texts_of

#: bytes other than a-z, 0-9 and parts of non-ASCII characters separate words; A-Z are lower-cased
SEPARATED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: fixed values: (label, phrase)
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: fixed values: (label, mandatory key phrase, notice), the wording licences ask to be put in a file
TEMPLATES = (
    (
        "gpl",
        "gnu general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "gnu lesser general public license", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "gnu affero general public license", "under the terms of the GNU Affero General Public License"),
    (
        "apache",
        "apache license",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License",
    ),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0"),
    (
        "mit",
        "permission is hereby granted free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files",
    ),
    ("mit", "mit license", "Released under the MIT License"),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    (
        "mpl",
        "mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    (
        "cc-by",
        "creative commons attribution",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "cc0 1 0 universal", "CC0 1.0 Universal"),
    ("all-rights-reserved", "all rights reserved", "All rights reserved"),
)

#: share of a template's weight that has to match in place
SHARE = 0.6


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(SEPARATED).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: tuple[bytes, ...]
    share: float
    base: bool


def base_templates(phrases=BASE_PHRASES) -> list[Template]:
    return [Template(label, tuple(words_of(p)), tuple(words_of(p)), 1.0, True) for label, p in phrases]


def notice_templates(notices=TEMPLATES, share: float = SHARE) -> list[Template]:
    return [Template(label, tuple(words_of(t)), tuple(words_of(p)), share, False) for label, p, t in notices]


class Index:
    """Postings of the templates' anchors, for given weights of words."""

    def __init__(self, templates: list[Template], weight: dict[bytes, float]):
        self.templates, self.weight = templates, weight
        self.totals = [sum(weight[w] for w in t.words) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for word in self.anchors(k, t):
                self.postings.setdefault(word, []).extend((k, q) for q, w in enumerate(t.words) if w == word)

    def anchors(self, k: int, t: Template) -> list[bytes]:
        """The heaviest words without all of which the required share is out of reach."""
        chosen, left = [], self.totals[k]
        for word in sorted(set(t.words), key=lambda w: (-self.weight[w], w)):
            chosen.append(word)
            left -= self.weight[word] * t.words.count(word)
            if left < t.share * self.totals[k] - 1e-9:
                break
        return chosen

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of base phrases, their labels, labels of templates, and the best template's matching share."""
        postings = self.postings
        votes = {(k, p - q) for p, word in enumerate(words) if word in postings for k, q in postings[word]}
        places, base, found, best = [], set(), set(), 0.0
        for k, at in votes:
            t = self.templates[k]
            region = words[max(0, at) : max(0, at + len(t.words))]
            lead = max(0, -at)
            same = sum(self.weight[a] for a, b in zip(t.words[lead:], region, strict=False) if a == b)
            share = same / self.totals[k]
            if share < t.share - 1e-9 or not holds(region, t.phrase):
                continue
            if t.base:
                places.append(at)
                base.add(t.label)
            found.add(t.label)
            best = max(best, share)
        return places, base, found, min(1.0, best)


def holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """word, docs: how many rows hold each word of the vocabulary; the row without a word counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches):
            for text in texts_of(batch):
                seen.update(vocabulary.intersection(words_of(text)))
            seen[None] += batch.num_rows
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if w is None else w.decode() for w in names], pa.string()),
                pa.array([seen[w] for w in names], pa.int64()),
            ],
            ["word", "docs"],
        )

    return docs.select("text").mapInArrow(run, "word string, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))


def word_weights(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """Inverse document frequencies of the vocabulary, which is that of the templates and so of known size."""
    rows = {r["word"]: r["docs"] for r in document_frequencies(docs, vocabulary).collect()}
    n = rows.get(None) or 0
    return {w: math.log(1 + (n + 1) / (rows.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs.

    n_base counts the places where a base phrase's words stand one after another; first_word and last_word are
    the smallest and largest of them, null without one; words count from 0.  labels has the labels of base
    phrases and of verified templates.  Lists are distinct, sorted and joined by commas, empty without a
    label.  score is the best match's share of its template's weight, 1 for a whole match, 0 for none.

    Null, empty and wordless texts have no words and no labels.  Repeated rows give repeated results, and each
    counts for the weights.  An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    templates = templates or [*base_templates(), *notice_templates()]
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, word_weights(docs, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in texts_of(batch):
                words = words_of(text)
                places, base, found, best = index.value.scan(words)
                rows.append(
                    (
                        len(words),
                        len(places),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(found)),
                        best,
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_hash"), *out], NAMES)

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, SCHEMA)


SCHEMA = (
    "doc_id bigint, text_hash bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
    " base_labels string, labels string, score double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
