"""Operator 10: license scans with MinHash bands over overlapping windows.

Templates are a small table of notices. A document's words are read as shingles of five; for each size class of templates
the shingles are cut to blocks, and a window is a few consecutive blocks, moved on by one block, so that any passage as
long as a template and half of it lies whole in some window. For each band the window's least hash is compared with the templates'; a
band is one MinHash value. The number of bands follows from the class: a window that holds `containment` of a template's
shingles collides in at least one band with probability 1 - MISS or more (the windows' size bounds the Jaccard similarity from
below). Windows that collide are verified: the template's distinct shingles that occur near the window are counted exactly, in
runs without large gaps and in passages of up to that length.

One scan, no shuffle; the templates go along with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import beside, bounded_batches, renamed
from ._text import ALNUM_WORD, LOWER, SpanHash, blocks, column_bytes, word_bounds, word_hashes

SHINGLE, MISS = 5, 1e-6
#: Most characters of all templates together: they are part of each task's closure.
MOST_TEMPLATES = 4_000_000

# Usual wordings of license notices, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _shingles(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the shingles of a block, and the bounds of each document's. A shorter text has none."""
    d = LOWER[d]
    s, e, words = word_bounds(d, o, ALNUM_WORD)
    count = np.maximum(np.diff(words) - SHINGLE + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) + np.repeat(words[:-1] - bounds[:-1], count)
    return SpanHash(word_hashes(d, s, e))(at, at + SHINGLE), bounds


class Templates:
    """Templates in size classes, with their bands."""

    def __init__(self, templates: list[tuple[str, str]], containment: float) -> None:
        if sum(len(text) for _, text in templates) > MOST_TEMPLATES:
            raise ValueError("too many templates for a closure")
        self.share = Fraction(str(containment))
        self.names, self.sets, sizes = [], [], []
        for name, text in templates:
            data, offsets = column_bytes(pa.array([text or ""], pa.large_string()))
            values, _ = _shingles(data, offsets)
            if len(values):  # a template of fewer than five words can't be found
                self.names.append(name)
                self.sets.append(np.unique(values))
                sizes.append(len(values))
        self.sizes, self.classes = sizes, []
        classes: dict[int, list[int]] = {}
        for k, size in enumerate(sizes):
            classes.setdefault(max(0, math.ceil(math.log2(size)) - 1), []).append(k)
        for c, members in sorted(classes.items()):
            block, longest = 1 << c, max(sizes[k] for k in members)
            width = -(-(self.reach(longest) - 1) // block) + 1
            # the template's distinct shingles in the window, over those of both
            least = min(math.ceil(self.share * len(self.sets[k])) / (width * block + len(self.sets[k]) - math.ceil(self.share * len(self.sets[k]))) for k in members)
            bands = 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))
            random = np.random.default_rng(100 + c)
            factors = random.integers(0, 1 << 31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            least_of = np.array([[self._hash(self.sets[k], f).min() for k in members] for f in factors])
            self.classes.append((block, width, longest, np.array(members), factors, least_of))

    @staticmethod
    def reach(size: int) -> int:
        """Shingles of the longest passage that is looked at as a whole for a template of so many: inserted words lengthen it."""
        return size + size // 2

    @staticmethod
    def _hash(values: np.ndarray, factor: np.uint32) -> np.ndarray:
        x = ((values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)) * factor
        return x ^ (x >> np.uint32(15))

    def find(self, values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first shingle, last shingle + 1, containment) of every verified passage."""
        hits: set[tuple[int, int, int]] = set()
        folded = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        sizes = np.diff(bounds)
        for block, width, longest, members, factors, least_of in self.classes:
            per = -(-sizes // block)
            first = np.cumsum(per) - per
            owner = np.repeat(np.arange(len(sizes)), per)
            starts = bounds[owner] + (np.arange(len(owner)) - first[owner]) * block
            if not len(starts):
                continue
            ends = first[owner] + per[owner]
            for factor, own in zip(factors, least_of, strict=True):
                x = folded * factor
                x ^= x >> np.uint32(15)
                low = np.minimum.reduceat(x, starts) if block > 1 else x
                wanted = np.unique(own)
                # blocks whose own least value is a template's: any window they belong to can have it as its least
                for at in np.flatnonzero(np.isin(low, wanted)).tolist():
                    for j in range(max(int(first[owner[at]]), at - width + 1), at + 1):
                        window = low[j : min(j + width, int(ends[at]))].min()
                        for k in members[own == window].tolist():
                            hits.add((int(owner[at]), k, int(starts[j] - bounds[owner[at]])))
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        spans = {k: (block * width, longest) for block, width, longest, members, _, _ in self.classes for k in members.tolist()}
        for doc, k, start in sorted(hits):
            length, longest = spans[k]
            a, b = bounds[doc] + max(0, start - longest), min(bounds[doc + 1], bounds[doc] + start + length + longest)
            at = np.flatnonzero(np.isin(values[a:b], self.sets[k]))
            for x, y, n in self._passages(at, values[a:b], len(self.sets[k]), longest, self.reach(self.sizes[k])):
                found.setdefault((doc, k), []).append((int(a - bounds[doc]) + x, int(a - bounds[doc]) + y, n / len(self.sets[k])))
        out = []
        for (doc, k), own in found.items():
            for x, y, share in sorted(set(own)):
                out.append((doc, k, x, y, share))
        return out

    def _passages(self, at: np.ndarray, values: np.ndarray, size: int, longest: int, reach: int) -> Iterator[tuple[int, int, int]]:
        """Passages that hold enough of the template: runs of its shingles, none further apart than a fifth of it, and between
        such runs the best stretches of at most `reach` shingles, whatever their gaps."""
        if not len(at):
            return
        gap = max(1, longest // 5 + 1)
        rest: list[np.ndarray] = []
        for part in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1):
            n = len(np.unique(values[part]))
            if self._enough(n, size):
                yield int(part[0]), int(part[-1]) + 1, n
                yield from self._stretches(rest, values, size, reach)
                rest = []
            else:
                rest.append(part)
        yield from self._stretches(rest, values, size, reach)

    def _enough(self, n: int, size: int) -> bool:
        return n * self.share.denominator >= self.share.numerator * size

    def _stretches(self, parts: list[np.ndarray], values: np.ndarray, size: int, reach: int) -> Iterator[tuple[int, int, int]]:
        if len(parts) < 2 or not self._enough(len(np.unique(values[np.concatenate(parts)])), size):
            return
        at = np.concatenate(parts)
        where, own = at.tolist(), values[at].tolist()
        inside: dict[int, int] = {}
        found, first = [], 0
        for last, value in enumerate(own):  # the stretch that ends at each shingle, without what repeats at its start
            inside[value] = inside.get(value, 0) + 1
            while where[last] - where[first] >= reach or inside[own[first]] > 1:
                inside[own[first]] -= 1
                if not inside[own[first]]:
                    del inside[own[first]]
                first += 1
            if self._enough(len(inside), size):
                found.append((-len(inside), where[last] - where[first], where[first], where[last] + 1))
        kept: list[tuple[int, int]] = []
        for n, _, x, y in sorted(found):  # of those that overlap, the one that holds most
            if all(y <= c or d <= x for c, d in kept):
                kept.append((x, y))
                yield x, y, -n


_MATCHES = "array<struct<license:string,start:int,end:int,containment:double>>"


def _finder(templates: Templates, n_carried: int):
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(n_carried))
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, _, d, o in blocks(data, offsets):
                best: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
                for doc, k, a, b, share in templates.find(*_shingles(d, o)):
                    best.setdefault((doc, templates.names[k]), []).append((a, b + SHINGLE - 1, share))
                for (doc, name), spans in sorted(best.items()):
                    kept: list[tuple[int, int, float]] = []  # of passages that overlap, the longest
                    for span in sorted(spans, key=lambda x: (x[0] - x[1], x[0], -x[2])):
                        if all(span[1] <= x[0] or x[1] <= span[0] for x in kept):
                            kept.append(span)
                    rows[first + doc] += [{"license": name, "start": a, "end": b, "containment": share} for a, b, share in kept]
            for own in rows:
                own.sort(key=lambda x: (x["start"], x["license"], x["end"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], pa.array(rows, kind)], names=[*batch.schema.names[:n_carried], "__matches"])

    return run


def scan_licenses(documents: DataFrame, text_col: str = "text", carry: list[str] | None = None, templates: list[tuple[str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """documents' columns (or those in carry) and `__matches`: license, start, end (words, end exclusive), containment.

    A match is a passage with at least `containment` of the distinct five-word shingles of a template, be it at most half as
    long again as the template (in shingles) or without a gap of over a fifth of it between them; A-Z counting as a-z and words being `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; of overlapping matches of one license the longest stays.

    Null and empty texts and texts of fewer than five words match nothing; templates of fewer than five words are ignored;
    repeated rows are repeated in the result; other columns are carried along as they are, but one named __matches gets
    underscores in front; an empty table gives an empty result. A text is held whole in one task.
    """
    bounded_batches(documents.sparkSession)
    carry = documents.columns if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    source = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(text_col).cast("string").alias("__text"))
    known = Templates(TEMPLATES if templates is None else templates, containment)
    matches = source.select(F.lit(None).cast(_MATCHES).alias("__matches")).schema
    schema = source.drop("__text").schema
    schema.fields.append(matches["__matches"])
    schema.names.append("__matches")
    done = source.mapInArrow(_finder(known, len(carry)), schema)
    return renamed(done, beside(carry, "__matches"), "__matches")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (license:start:end, comma-joined by start) and least_containment of every document."""
    done = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    written = F.transform("__matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return done.select("doc_id", F.size("__matches").cast("long").alias("n_matches"), F.array_join(written, ",").alias("licenses"), F.array_min(F.transform("__matches", lambda x: x["containment"])).alias("least_containment"))
