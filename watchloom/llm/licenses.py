"""License scan: MinHash bands over overlapping text windows, then exact containment.

Templates are grouped by length into classes of windows. Windows of a class slide over a text
in small steps, so a copy of a template always lies inside a window that is little longer. The
signatures of a window are cut into bands; a template that shares a band is a candidate, and a class
has enough bands that a window with the least similarity that a true match can have meets its template
with probability ``CERTAINTY`` or more. Candidates are verified by the exact share of the template's
shingles found there.

Texts never leave their partition. The band tables of the templates travel to the tasks; templates
are a fixed set whose size is checked (``MAX_WORDS``).

Defined results: a shingle is five words (``\\w+``, lower case); a template needs five words at least; a
null or empty text, or one under five words, matches nothing; one of any length is scanned whole;
every template at or over ``threshold`` is reported once per row with its best place, ties by the
earlier one; repeated rows are scanned each; no templates match nothing; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
CERTAINTY = 0.99
MAX_WORDS = 1_000_000
#: Shingles looked through at once.
SLICE = 100_000
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Wording of public licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingle_hashes(words: list[str], hashes: WordHashes) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + each[k : k + n]
    return out ^ (out >> np.uint64(32))


def band_settings(likeness: float, certainty: float = CERTAINTY) -> tuple[int, int]:
    """(bands, rows): sets of Jaccard ``likeness`` share a band with probability ``certainty`` or more.

    Of one to three rows the most that need 16 bands at most; else one row, as many bands as it takes.
    Equal sets share every band, so one of one row will do.
    """
    if likeness >= 1:
        return 1, 1
    for rows in (3, 2, 1):
        p = likeness**rows
        bands = math.ceil(math.log(1 - certainty) / math.log(1 - p))
        if bands <= 16 or rows == 1:
            return bands, rows
    raise AssertionError


@dataclass
class WindowClass:
    """Windows of ``blocks`` blocks of ``step`` shingles, for templates of up to ``longest`` shingles."""

    longest: int
    step: int = 1
    blocks: int = 1
    bands: int = 1
    rows: int = 1
    names: list[str] = field(default_factory=list)
    tables: list[dict[int, list[str]]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.step * self.blocks


class Scanner:
    """Band tables of the templates, and the scan of one text."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold, self.hashes = threshold, WordHashes()
        self.words = {name: words_of(text) for name, text in templates.items()}
        if sum(map(len, self.words.values())) > MAX_WORDS:
            raise ValueError(f"templates over {MAX_WORDS} words")
        if short := [name for name, w in self.words.items() if len(w) < SHINGLE]:
            raise ValueError(f"templates under {SHINGLE} words: {short}")
        self.shingles = {name: self._strings(w) for name, w in self.words.items()}
        self.classes = self._classes()
        self.widest = max([c.size for c in self.classes], default=0)
        top = max([c.bands * c.rows for c in self.classes], default=0)
        random = np.random.default_rng(7)
        self.mix = random.integers(1, 1 << 63, top, np.uint64) * np.uint64(2) + np.uint64(1)
        for c in self.classes:
            c.tables = [{} for _ in range(c.bands)]
            for name in c.names:
                h = shingle_hashes(self.words[name], self.hashes)
                signature = np.array([self._mixed(h, k).min() for k in range(c.bands * c.rows)])[:, None]
                for table, key in zip(c.tables, self._band_keys(signature, c), strict=True):
                    table.setdefault(int(key[0]), []).append(name)

    def _strings(self, words: list[str]) -> set[str]:
        return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}

    def _classes(self) -> list[WindowClass]:
        found: dict[int, WindowClass] = {}
        for name, words in sorted(self.words.items()):
            n = len(words) - SHINGLE + 1
            longest = n if n <= 8 else math.ceil(8 * 1.25 ** math.ceil(math.log(n / 8, 1.25)))
            found.setdefault(longest, WindowClass(longest)).names.append(name)
        for c in found.values():
            c.step = max(1, c.longest // 8)
            # Any run of ``longest`` shingles lies inside a window with one more block.
            c.blocks = c.longest if c.step == 1 else math.ceil(c.longest / c.step) + 1
            least = min(len(self.shingles[name]) for name in c.names)
            met = math.ceil(self.threshold * least)
            c.bands, c.rows = band_settings(met / (c.size + least - met))
        return sorted(found.values(), key=lambda c: c.longest)

    def _mixed(self, h: np.ndarray, k: int) -> np.ndarray:
        x = h * self.mix[k]
        return x ^ (x >> np.uint64(31))

    def _band_keys(self, signature: np.ndarray, c: WindowClass) -> list[np.ndarray]:
        keys = []
        for band in range(c.bands):
            key = np.zeros(signature.shape[1], np.uint64)
            for row in range(c.rows):
                key = (key ^ (key >> np.uint64(27))) * _PRIME + signature[band * c.rows + row]
            keys.append(key)
        return keys

    def _signatures(self, h: np.ndarray) -> list[np.ndarray]:
        """Per class the minima of each hash function over each window; windows start at every block."""
        out = [np.empty((c.bands * c.rows, max(0, -(-len(h) // c.step) - c.blocks + 1)), np.uint64) for c in self.classes]
        for k in range(len(self.mix)):
            mixed = self._mixed(h, k)
            for c, signature in zip(self.classes, out, strict=True):
                if k >= len(signature) or not signature.shape[1]:
                    continue
                low = np.minimum.reduceat(mixed, np.arange(0, len(h), c.step)) if c.step > 1 else mixed
                done = 1
                while done < c.blocks:  # minima of runs of blocks, doubling
                    more = min(done, c.blocks - done)
                    low = np.minimum(low[: len(low) - more], low[more:])
                    done += more
                signature[k] = low
        return out

    def _candidates(self, h: np.ndarray):
        """(template, first shingle, end) of windows that share a band with a template, a window wider on either side."""
        # Windows never end with a text: what follows it in the row of texts, or nothing, fills them up.
        h = np.concatenate([h, np.full(self.widest, np.iinfo(np.uint64).max, np.uint64)])
        for c, signature in zip(self.classes, self._signatures(h), strict=True):
            for table, keys in zip(c.tables, self._band_keys(signature, c), strict=True):
                hits = [np.flatnonzero(keys == key) for key in table] if len(table) <= 4 else [np.flatnonzero(np.isin(keys, np.fromiter(table, np.uint64, len(table))))]
                for k in np.concatenate(hits).tolist():
                    for name in table[int(keys[k])]:
                        yield name, (k - c.blocks) * c.step, (k + 2 * c.blocks) * c.step

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words) of each template found, by name."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """``scan`` of each text. Texts are looked through one after the other in slices of bounded length."""
        best: list[dict[str, tuple[float, int, int]]] = [{} for _ in texts]
        words = [words_of(t) if t else [] for t in texts]
        hashes = [shingle_hashes(w, self.hashes) for w in words]
        ends = np.cumsum([len(h) for h in hashes])
        row = np.concatenate([np.empty(0, np.uint64), *hashes])
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for start in range(0, len(row) if self.classes else 0, SLICE):
            for name, a, b in self._candidates(row[start : start + SLICE + self.widest]):
                a, b = max(0, start + a), min(len(row), start + b)
                doc = int(np.searchsorted(ends, a, "right"))
                while a < b:  # a window may lie over several texts
                    base, end = int(ends[doc]) - len(hashes[doc]), int(ends[doc])
                    spans.setdefault((doc, name), []).append((a - base, min(b, end) - base))
                    a, doc = end, doc + 1
        for (doc, name), found in spans.items():
            for a, b in _merged(found):
                here = self._verify(name, words[doc], a, b)
                if here and (name not in best[doc] or (-here[0], here[1]) < (-best[doc][name][0], best[doc][name][1])):
                    best[doc][name] = here
        return [[(name, *found) for name, found in sorted(b.items())] for b in best]

    def _verify(self, name: str, words: list[str], a: int, b: int) -> tuple[float, int, int] | None:
        """Best run of template-long windows in shingles a to b: exact share of the template's shingles."""
        wanted, size = self.shingles[name], len(self.words[name]) - SHINGLE + 1
        hits = [(i, s) for i in range(a, b) if (s := " ".join(words[i : i + SHINGLE])) in wanted]
        room, counts, left, top = size + size // 4, {}, 0, (0, 0, 0)
        for i, s in hits:
            counts[s] = counts.get(s, 0) + 1
            while hits[left][0] <= i - room:
                old = hits[left][1]
                counts[old] -= 1
                if not counts[old]:
                    del counts[old]
                left += 1
            if len(counts) > top[0]:
                top = len(counts), hits[left][0], i + SHINGLE - hits[left][0]
        share = top[0] / len(wanted)
        return (share, top[1], top[2]) if share >= self.threshold else None


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        elif a < b:
            out.append((a, b))
    return out


def scan_column(docs: DataFrame, templates: dict[str, str], text: str = "text", threshold: float = THRESHOLD) -> Column:
    """Array of (template, containment, first_word, n_words) for ``text``."""
    own: list[Scanner] = []
    Scanner(templates, threshold)  # refuses unfit templates on the driver
    kind = "array<struct<template:string,containment:double,first_word:bigint,n_words:bigint>>"
    names = ("template", "containment", "first_word", "n_words")
    row = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))))

    def batch(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Scanner(templates, threshold))
        found = [f for k in range(0, len(texts), 200) for f in own[0].scan_all(texts.slice(k, 200).to_pylist())]
        return pa.array([[dict(zip(names, m, strict=True)) for m in f] for f in found], row)

    return F.arrow_udf(batch, kind).asNondeterministic()(docs[f"`{text}`"].cast("string"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` and template found in it."""
    found = docs.select(docs[f"`{id_col}`"].alias("doc_id"), scan_column(docs, templates, text, threshold).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """One row per document and license template that stands in it."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
