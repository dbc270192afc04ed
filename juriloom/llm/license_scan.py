"""Licence scan by a positional index of template words.

Templates are licence notices, and clauses of whole licences one by one, so that names filled in between don't shift them. Their words' document frequencies are counted over all documents. In a file, every
licence word is looked up in the templates' postings; each meeting votes for a template and its place in the file, with
the word's inverse frequency. The score of a place is the share of the template's weight that stands in place; places
where two words or more do are kept, and the template's label is given if the score is at least ``least`` and a mandatory
key phrase stands inside. Places are judged one by one on the full text, so a file may hold any number of licences, and
stray licence words hide none.

Beside it, given phrases are found wherever their words stand in turn, and give their labels in any case.

Defined cases: null and empty texts have no words, labels or places and score 0; repeated rows are each returned; an
empty table gives an empty result; further columns of any name are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALPHANUMERIC, U, Words, hash_word, slices, windows, words

# Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, notice, and the key phrases of which one must stand in place.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2", "apache license 2"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3", "gnu general public license v3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2", "gnu general public license v2"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("public-domain", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["deal in the software without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["shall be included in all copies or substantial portions of the software"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed under the license is distributed on an as is basis"]),
    ("gpl-3", "either version 3 of the license or at your option any later version", ["version 3 of the license or at your option any later version"]),
    ("gpl-2", "either version 2 of the license or at your option any later version", ["version 2 of the license or at your option any later version"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose including commercial applications"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["copyright notice and this permission notice appear in all copies"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", ["anyone is free to copy modify publish use compile sell or distribute"]),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed with this file"]),
]
LEAST = 0.6


class Index(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # inverse frequency of each
    templates: list[tuple[str, np.ndarray, list[np.ndarray]]]  # label, words by number, key phrases by number
    posting_bounds: np.ndarray  # by word
    posting_template: np.ndarray
    posting_place: np.ndarray


def _hashes(phrase: str) -> np.ndarray:
    return np.array([hash_word(w) for w in phrase.split()], U)


def build(frequencies: np.ndarray | None = None, n_docs: int = 0) -> Index:
    vocabulary = np.unique(np.concatenate([_hashes(" ".join([t, *keys])) for _, t, keys in TEMPLATES]))
    number = lambda phrase: np.searchsorted(vocabulary, _hashes(phrase))
    templates = [(label, number(t), [number(k) for k in keys]) for label, t, keys in TEMPLATES]
    seen = np.zeros(len(vocabulary)) if frequencies is None else frequencies
    word = np.concatenate([t for _, t, _ in templates])
    which = np.repeat(np.arange(len(templates)), [len(t) for _, t, _ in templates])
    place = np.concatenate([np.arange(len(t)) for _, t, _ in templates])
    order = np.lexsort((place, which, word))
    return Index(vocabulary, np.log((n_docs + 1) / (seen + 1)) + 0.05, templates, np.searchsorted(word[order], np.arange(len(vocabulary) + 1)), which[order], place[order])


def licence_words(index: Index, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places in all words, and numbers of the words that templates have."""
    at = np.minimum(np.searchsorted(index.vocabulary, w.hashes), len(index.vocabulary) - 1)
    places = np.flatnonzero(index.vocabulary[at] == w.hashes)
    return np.searchsorted(w.bounds, places, "right") - 1, places, at[places]


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(index.vocabulary)
        for batch in batches:
            counts = np.zeros(n + 1, np.int64)
            for texts in slices(batch.column("text")):
                text, _, word = licence_words(index, words(texts, ALPHANUMERIC, lower=True))
                counts[:n] += np.bincount(np.unique(text * n + word) % n, minlength=n)
                counts[n] += texts.hi - texts.lo
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(n + 1), pa.int32()), "n": pa.array(counts)})

    return run


def matches(index: Index, w: Words, least: float = LEAST) -> tuple[list[set[str]], np.ndarray]:
    """Labels and the best score of each text."""
    rows = len(w.bounds) - 1
    labels, best = [set() for _ in range(rows)], np.zeros(rows)
    text, places, word = licence_words(index, w)
    if not len(places):
        return labels, best
    number = np.full(len(w.hashes), -1)
    number[places] = word
    # each licence word votes for every template and start at which it would stand in place
    many = (index.posting_bounds[1:] - index.posting_bounds[:-1])[word]
    vote = np.repeat(np.arange(len(places)), many)
    k = np.arange(len(vote)) - np.repeat(np.cumsum(many) - many, many) + index.posting_bounds[word][vote]
    room = max(len(t) for _, t, _ in index.templates)  # keeps the starts of texts apart
    start = places[vote] + (text[vote] + 1) * room - index.posting_place[k]
    at, first, which, n = np.unique(start * len(index.templates) + index.posting_template[k], return_index=True, return_inverse=True, return_counts=True)
    total = np.array([index.weights[t].sum() for _, t, _ in index.templates])
    template, of = at % len(index.templates), text[vote[first]]
    score = np.bincount(which, index.weights[word[vote]], len(at)) / total[template]
    for c in np.flatnonzero((n >= 2) & (score >= least)).tolist():
        label, words_of, keys = index.templates[template[c]]
        i = int(of[c])
        begin = int(at[c]) // len(index.templates) - (i + 1) * room
        span = number[max(begin, int(w.bounds[i])) : min(begin + len(words_of) + 2, int(w.bounds[i + 1]))]
        if any((span[s : s + len(key)] == key).all() for key in keys for s in range(len(span) - len(key) + 1)):
            labels[i].add(label)
            best[i] = max(best[i], score[c])
    return labels, best


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    plain = build()
    counted = {r["word"]: r["n"] for r in picked.mapInArrow(_frequencies(plain), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one for each template word
    n = len(plain.vocabulary)
    index = build(np.array([counted.get(i, 0) for i in range(n)], float), counted.get(n, 0))
    phrases = [(_hashes(p), label) for p, label in PHRASES.items()]
    whole = [(windows(h, len(h))[0], len(h), label) for h, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                w = words(texts, ALPHANUMERIC, lower=True)
                rows = texts.hi - texts.lo
                n_words = np.diff(w.bounds)
                found = [set() for _ in range(rows)]
                places: list[list[int]] = [[] for _ in range(rows)]
                for h, size, label in whole:
                    at = np.flatnonzero(windows(w.hashes, size) == h)
                    of = np.searchsorted(w.bounds, at, "right") - 1
                    for i, p in zip(of.tolist(), at.tolist(), strict=True):
                        if p + size <= w.bounds[i + 1]:  # not over the end of a text
                            found[i].add(label)
                            places[i].append(int(p - w.bounds[i]))
                own, score = matches(index, w)
                labels = [",".join(sorted(a | b)) for a, b in zip(own, found, strict=True)]
                scores = [1.0 if f else min(x, 1.0) for f, x in zip(found, score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[texts.lo : texts.hi], pa.array(n_words, pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()),
                    pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()),
                ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
