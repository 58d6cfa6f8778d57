"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures and places them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.shared import slices
from zonestudy.llm.words import PUNCTUATION, hash_words, tokenize, windows

SCHEMA = "doc_id long, license string, matched_words int, coverage double, start_byte long, end_byte long"
#: Cells of an alignment's rows that are held at once.
CELLS = 1 << 20

#: Public license notices and grants, by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
}


@dataclass
class Index:
    """The templates' words, and their fingerprints by shingle length: hashes in order, template and position of each."""

    names: list[str]
    words: list[np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every run of ``window`` hashes, the last of equal ones; of fewer hashes the least one."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs, axis=1))


def kind_of(n: int) -> tuple[int, int]:
    """Words of a shingle and of a winnowing window for a template of ``n`` words. Short templates keep all their shingles, and short ones:
    of the words of which a quarter are changed, two neighbours stay."""
    return (min(n, 2), 1) if n < 20 else (3, 1) if n < 40 else (4, 4)


def index(templates: dict[str, str] | list[tuple[str, str]]) -> Index:
    """Fingerprints of every template (see ``kind_of``), whether or not others have its name. Templates without words have none."""
    templates = list(templates.items()) if isinstance(templates, dict) else templates
    words = [hash_words(text or "", PUNCTUATION) for _, text in templates]
    found: dict[int, list] = {}
    for i, w in enumerate(words):
        k, window = kind_of(len(w))
        if k:
            hashes, _ = windows(w, np.zeros(len(w), dtype=np.int64), tuple(range(k)))
            at = winnow(hashes, window)
            found.setdefault(k, []).append((hashes[at], np.full(len(at), i), at))
    tables = {}
    for k, parts in found.items():
        hashes, template, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        tables[k] = (hashes[order], template[order], at[order])
    return Index([name for name, _ in templates], words, tables)


#: Places of score, words matched and start in one number, so that the larger one is the better one.
_SCORE, _MATCHED = 40, 20


def align(template: np.ndarray, texts: np.ndarray, inside: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words matched, first, end in the row) of the best local alignment of ``template`` with each row of ``texts``, in which template word i
    lies at one of the columns i to i + 2 * band. A match scores 2, a mismatch or a gap -1; of equal scores the one with the earliest end
    is taken. Columns that aren't ``inside`` match nothing. All rows go through the table together, cell by cell."""
    one, top = np.int64(1), np.int64((1 << _MATCHED) - 1)
    width, rows = 2 * band + 1, len(texts)
    fresh = top - np.arange(texts.shape[1] + 1)  # score 0, nothing matched, begins here
    best, end = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    before = np.repeat(fresh[None, : width + 1], rows, axis=0)
    for i, word in enumerate(template):
        row = np.empty_like(before)
        row[:, width] = fresh[i + width]
        left = np.full(rows, fresh[i])
        for t in range(width):
            j = i + t
            equal = (texts[:, j] == word) & inside[:, j]
            corner = np.where(before[:, t] >> _SCORE > 0, before[:, t], fresh[j])
            corner = np.where(equal, corner + (one << (_SCORE + 1)) + (one << _MATCHED), corner - (one << _SCORE))
            left = np.maximum(corner, np.maximum(before[:, t + 1], left) - (one << _SCORE))
            left = np.where(left >> _SCORE > 0, left, fresh[j])
            row[:, t] = left
            better = left >> _SCORE > best >> _SCORE
            best, end = np.where(better, left, best), np.where(better, j + 1, end)
        before = row
    return best >> _MATCHED & top, top - (best & top), end


def scan_texts(texts: pa.Array, own: Index, min_coverage: float, band: int) -> list[tuple[int, int, int, float, int, int]]:
    """(row, template, words matched, coverage, first and last byte) of every place where a template is covered enough.

    Hits of one template on close diagonals are one candidate, aligned within twice ``band`` of it; places that overlap an earlier one
    of the same template are the same place, the best of which is kept."""
    w = tokenize(texts, PUNCTUATION)
    first = np.concatenate([[0], np.cumsum(w.counts())])
    hits = [np.zeros((0, 3), dtype=np.int64)]
    for k, (hashes, templates, places) in own.tables.items():
        found, at = windows(w.hash, w.doc, tuple(range(k)))
        low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        many = high - low
        at, j = np.repeat(at, many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        hits.append(np.stack([w.doc[at], templates[j], at - places[j]], axis=1))
    hits = np.concatenate(hits)
    hits = hits[np.lexsort(hits.T[::-1])]
    _, keep = np.unique(np.stack([hits[:, 0], hits[:, 1], hits[:, 2] // (band + 1)], axis=1), axis=0, return_index=True)
    hits, out = hits[keep], []
    for template in np.unique(hits[:, 1]):
        words, hit = own.words[template], hits[hits[:, 1] == template]
        for part in np.array_split(hit, -(-len(hit) * (len(words) + 4 * band) // CELLS)):
            columns = part[:, 2:] - 2 * band + np.arange(len(words) + 4 * band)
            inside = (columns >= first[part[:, :1]]) & (columns < first[part[:, :1] + 1])
            matched, s, e = align(words, w.hash[np.clip(columns, 0, len(w.hash) - 1)], inside, 2 * band)
            for i in np.flatnonzero((matched > 0) & (matched >= min_coverage * len(words))):
                row, a, b = part[i, 0], columns[i, s[i]], columns[i, e[i] - 1]
                out.append((int(row), int(template), int(matched[i]), matched[i] / len(words), int(w.start[a] - w.offsets[row]), int(w.end[b] - w.offsets[row])))
    places: list[tuple[int, int, int, float, int, int]] = []
    for x in sorted(out, key=lambda x: (x[0], x[1], x[4], x[5])):
        if places and places[-1][:2] == x[:2] and x[4] < places[-1][5]:
            places[-1] = max(places[-1], x, key=lambda y: y[2])
        else:
            places.append(x)
    return places


def _blocks(templates: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct rows of ``templates`` in blocks of about ``block_bytes``; an empty one if there are none."""
    held: list[tuple[str, str]] = []
    size, none = 0, True
    for name, text in templates.select("license", "text").distinct().toLocalIterator():
        held.append((name, text))
        size, none = size + len(text or ""), False
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held or none:
        yield held


def scan(docs: DataFrame, templates: DataFrame | None = None, min_coverage: float = 0.75, band: int = 4, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, license, matched_words, coverage, start_byte, end_byte: every place of a document's whole text that holds
    ``min_coverage`` of a template's words in order.

    ``templates`` has license (a name) and text; without it the few notices and grants above are taken. Several texts can have one name, or none: each is
    sought by itself, so two of them can report one place; equal rows are one template. Words are runs of letters and digits,
    A-Z lower-cased. Every shingle of a text is looked up among the templates' fingerprints: of templates of 40 words and more winnowed
    ones of four words, of shorter ones all of three or two, so that a place in which a quarter of the words are changed is still a
    candidate. Candidates are aligned in a band, so words put in or left out are allowed, too. The templates are read in blocks of
    ``block_bytes``, each broadcast and met in one pass over the documents, which are never shuffled. Null and empty texts and templates hold no
    license; repeated rows are scanned one by one; other columns are ignored; no rows or templates give no rows."""
    out, spark = None, docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in [TEMPLATES] if templates is None else _blocks(templates, block_bytes):
        part = docs.mapInArrow(_scanner(spark.sparkContext.broadcast(index(block)), min_coverage, band), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _scanner(shared: Broadcast, min_coverage: float, band: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id")
            rows = [(ids[r].as_py(), own.names[t], m, c, s, e) for r, t, m, c, s, e in scan_texts(batch.column("text"), own, min_coverage, band)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "matched_words", "coverage", "start_byte", "end_byte"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], type=kind) for k, kind in enumerate(kinds)], names=names)

    return each
