"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

A template's fingerprints are hashes of its runs of words, thinned so that every window of
consecutive runs keeps its smallest hash.  An index from fingerprint to template and place
gives candidates: a diagonal of text against template.  An alignment in a band around the
diagonal says how much of the template the text holds, and where.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import mixed, steps, table, words_of

RUN, WINDOW = 3, 2
#: Words that text and template may be shifted against each other along a candidate.
BAND = 8
#: Share of a template's words that a match must hold, in order.
COVERAGE = 0.8

# Short notices and standard headers of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
}
_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    """Words of letters and digits in lower case."""
    return [m.group().lower() for m in _WORD.finditer(text)]


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 7)


def _run_hashes(hashes: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of consecutive words."""
    n = len(hashes) - run + 1
    return mixed(*(hashes[k : k + n] for k in range(run))) if n > 0 else np.zeros(0, dtype=np.uint64)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window (the last one of equals); a short row keeps one."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Index:
    """Fingerprints of the templates; as large as the list of templates."""

    def __init__(self, templates: dict[str, str], run: int = RUN, window: int = WINDOW):
        self.run, self.window = run, window
        self.names = list(templates)
        self.terms = [terms(t) for t in templates.values()]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.terms):
            hashes = _run_hashes(np.array([_hash(w) for w in words], dtype=np.uint64), run)
            for at in winnow(hashes, window):
                self.postings[int(hashes[at])].append((k, int(at)))
        self.keys = np.array(sorted(self.postings), dtype=np.uint64)

    def candidates(self, hashes: np.ndarray, band: int) -> list[tuple[int, int]]:
        """Templates and diagonals (text place minus template place), one for each band of them."""
        own = _run_hashes(hashes, self.run)
        picked = winnow(own, self.window)
        picked = picked[np.isin(own[picked], self.keys)]
        found = {(k, int(at) - place) for at in picked for k, place in self.postings[int(own[at])]}
        out: list[tuple[int, int]] = []
        for k, diagonal in sorted(found):
            if not out or out[-1][0] != k or diagonal - out[-1][1] > self.band(k, band):
                out.append((k, diagonal))
        return out

    def band(self, k: int, most: int) -> int:
        """The band of a template: under half of its words, so that two notices in a row are two."""
        return min(most, (len(self.terms[k]) - 1) // 2)


def align(text: list[str], template: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Template words held in order near a diagonal, and the first and last of their places in the text.

    Longest common subsequence in the cells whose place in the text is within ``band`` of the
    diagonal; of equal ones the one that ends first, and begins last.
    """
    low = max(0, diagonal - band)
    part = text[low : diagonal + len(template) + band]
    width = 2 * band + 1
    # best[j]: (words held, minus the place of the first) for text cells of the row before.
    none = (0, 0)
    best = [none] * (len(part) + 1)
    for i, word in enumerate(template):
        center = diagonal + i - low
        row = best[:]
        for j in range(max(0, center - band), min(len(part), center - band + width)):
            if part[j] == word:
                held, first = best[j]
                match = (held + 1, first if held else j)
                if match > row[j + 1]:
                    row[j + 1] = match
            if row[j] > row[j + 1]:
                row[j + 1] = row[j]
        for j in range(min(len(part), max(0, center - band + width)), len(part)):
            if row[j] > row[j + 1]:
                row[j + 1] = row[j]
            else:
                break
        best = row
    held, first = max(best)
    last = next(j for j, x in enumerate(best) if x == (held, first))
    return held, low + first, low + last - 1


def matches(text: str, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple]:
    """``license, coverage, first word, last word, begin, end`` (code points) of each match in a text.

    Of matches that overlap, the one that holds more words stays (then the first name).
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    hashes = np.array([_hash(w) for w in words], dtype=np.uint64)
    found = []
    for k, diagonal in index.candidates(hashes, band):
        template = index.terms[k]
        held, first, last = align(words, template, diagonal, index.band(k, band))
        if held >= coverage * len(template):
            found.append((-held, index.names[k], first, last, held / len(template)))
    taken: list[tuple] = []
    for held, name, first, last, share in sorted(found):
        if all(last < x[2] or first > x[3] for x in taken):
            taken.append((name, share, first, last, spans[first][0], spans[last][1]))
    return sorted(taken, key=lambda x: x[2])


@lru_cache(4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


_FOUND = "doc_id long, license string, coverage double, first_word int, last_word int, begin int, end int"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, first_word, last_word, begin, end`` for every match.

    Whole texts are scanned.  A text without a match, null or empty, has no row; one with
    several has several.  Rows without an id and repeated rows are scanned each on its own.
    Other columns are not read; an empty table gives an empty one.  The templates, a fixed
    list, go to every task.
    """
    fixed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(fixed)
        for batch in steps(batches, "text"):
            ids, texts = batch.column("doc_id"), batch.column("text")
            likely = _likely(texts, index).tolist()
            out = [(ids[k].as_py(), *m) for k in likely for m in matches(texts[k].as_py(), index, coverage)]
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            names = [f.split()[0] for f in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _FOUND)


def _likely(texts: pa.Array, index: Index) -> np.ndarray:
    """Rows that hold one of the index's runs of words anywhere: all that can have a candidate.

    Each distinct word of the batch is cut into its terms once; the runs of a text are then
    hashed for all rows of the batch together.
    """
    words, codes, offsets = words_of(texts)
    cut = [[w.lower()] if w.isalnum() else terms(w) for w in words]
    flat = np.array([_hash(t) for c in cut for t in c], dtype=np.uint64)
    sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    begin = np.cumsum(sizes) - sizes
    own = sizes[codes] if len(codes) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(own)
    place = np.repeat(begin[codes] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
    hashes = flat[place] if len(place) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), own)
    runs = _run_hashes(hashes, index.run)
    hit = np.flatnonzero(np.isin(runs, index.keys))
    return np.unique(row[hit][row[hit] == row[hit + index.run - 1]]) if len(hit) else np.zeros(0, dtype=np.int64)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
