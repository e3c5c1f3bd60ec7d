"""License notices in texts: MinHash bands over overlapping windows, verified by exact shingle containment."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shingles import Words, minhashes, normalized, permutations, slices, words_of

WIDTH, CONTAINMENT = 5, 0.8
#: Chance that bands miss a window which holds a template as well as the threshold asks.
MISS = 1e-5
SEED = 4242

# Wordings of licenses and of their usual notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-notice": "Released under the BSD License.",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-1.0-permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "zlib-disclaimer": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "cc0-1.0-waiver": "The person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
}
# Notices of fewer words than a shingle has: found word for word, inside longer texts too.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0-name": "CC BY 4.0",
    "cc0-1.0-name": "CC0 1.0 Universal",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
}


@dataclass
class Scale:
    """Templates of about one length: windows of ``steps`` strides, and the bands that must find them."""

    names: list[str]
    stride: int
    steps: int
    bands: int
    minima: np.ndarray  # templates x bands


@dataclass
class Library:
    scales: list[Scale]
    shingles: dict[str, np.ndarray]  # sorted distinct hashes of each template
    bands: int
    width: int
    containment: float
    places: dict[str, np.ndarray]  # where each of them first stands in its template
    lengths: dict[str, int]  # shingles of each template, repeated ones included
    short: dict[int, dict[int, list[str]]] = field(default_factory=dict)  # by words: the hash of all of them, and the names of its templates


def library(templates: dict[str, str], width: int = WIDTH, containment: float = CONTAINMENT, miss: float = MISS) -> Library:
    """Index templates. A window is long enough to hold its templates whole wherever they start.

    The number of one-value bands is the smallest for which a window that holds the
    threshold's share of a template's shingles collides with probability 1 - ``miss``.
    Templates of fewer than ``width`` words are one shingle of their own width and need no bands.
    """
    names = sorted(templates)
    words = words_of(normalized(pa.array([templates[k] for k in names], pa.string())))
    hashes, bound = words.shingles(width)
    sets, places, lengths, short = {}, {}, {}, {}
    for k, a, b, n in zip(names, bound[:-1], bound[1:], np.diff(words.first), strict=True):
        if n >= width:
            sets[k], places[k] = np.unique(hashes[a:b], return_index=True)
            lengths[k] = int(b - a)
        elif n:
            short.setdefault(int(n), {}).setdefault(int(hashes[a]), []).append(k)
    scales = []
    for power in sorted({len(x).bit_length() for x in sets.values()}):
        own = [k for k, x in sets.items() if len(x).bit_length() == power]
        sizes = [len(sets[k]) for k in own]
        stride = max(1, max(sizes) // 4)
        steps = -(-max(sizes) // stride) + 1
        needed = [max(1, int(np.ceil(containment * n - 1e-9))) for n in sizes]
        least = min(c / (steps * stride + n - c) for c, n in zip(needed, sizes, strict=True))
        scales.append(Scale(own, stride, steps, int(np.ceil(np.log(miss) / np.log1p(-least))) if least < 1 else 1, np.zeros(0)))
    bands = max((s.bands for s in scales), default=0)
    for s in scales:
        each = [minhashes(sets[k], np.array([0, len(sets[k])]), s.bands, SEED)[0] for k in s.names]
        s.minima = np.array(each)
    return Library(scales, sets, bands, width, containment, places, lengths, short)


def _retrieved(hashes: np.ndarray, bound: np.ndarray, lib: Library) -> Iterator[tuple[Scale, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (first shingle, end) and the templates of a scale that share a band with them."""
    count = np.diff(bound)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    grids = []
    for s in lib.scales:
        blocks = -(-count // s.stride)
        text = np.repeat(np.arange(len(count)), blocks)
        at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        left = np.repeat(blocks, blocks) - at  # blocks from here to the text's end
        grids.append((bound[:-1][text] + at * s.stride, bound[1:][text], left))
    hits: list[list[np.ndarray]] = [[] for _ in lib.scales]
    for j, (a, b) in enumerate(zip(*permutations(lib.bands, SEED), strict=True)):
        value = low * a
        value ^= value >> np.uint32(15)
        value *= b
        for s, (start, _, left), found in zip(lib.scales, grids, hits, strict=True):
            if j >= s.bands or not len(start):
                continue
            block = np.minimum.reduceat(value, start)
            window = block.copy()
            for k in range(1, s.steps):
                inside = left[:-k] > k
                np.minimum(window[:-k], block[k:], out=window[:-k], where=inside)
            order = np.argsort(s.minima[:, j], kind="stable")
            known = s.minima[order, j]
            rows = np.flatnonzero(known[np.minimum(np.searchsorted(known, window), len(known) - 1)] == window)
            first, last = (np.searchsorted(known, window[rows], side=side) for side in ("left", "right"))
            for k in range(int((last - first).max(initial=0))):  # templates that share a minimum
                more = first + k < last
                found.append(rows[more] * len(s.names) + order[first[more] + k])
    for s, (start, end, _), found in zip(lib.scales, grids, hits, strict=True):
        if found:
            pairs = np.unique(np.concatenate(found))
            row = pairs // len(s.names)
            yield s, start[row], np.minimum(start[row] + s.steps * s.stride, end[row]), pairs % len(s.names)


class _Taken:
    """Spans (first shingle, last shingle) of one template that share no word."""

    def __init__(self, width: int):
        self.width, self.spans = width, []

    def add(self, a: int, b: int) -> bool:
        """Take a span, unless it shares a word with one taken before."""
        i = bisect_left(self.spans, (a, b))
        if i and self.spans[i - 1][1] + self.width > a or i < len(self.spans) and self.spans[i][0] < b + self.width:
            return False
        insort(self.spans, (a, b))
        return True

    def gaps(self, at: np.ndarray) -> np.ndarray:
        """The gap between taken spans that each shingle lies in; -1 for one that shares a word with a span."""
        if not self.spans:
            return np.zeros(len(at), dtype=np.int64)
        first, last = np.array(self.spans).T
        i = np.searchsorted(first, at + self.width)
        return np.where((i > 0) & (last[i - 1] + self.width > at), -1, i)


def _shortest(at: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """The shortest span, of equal ones the first, that holds all the different shingles that ``at`` holds."""
    left, missing, a, best = {}, len(np.unique(place)), 0, None
    for b, p in enumerate(place.tolist()):
        left[p] = left.get(p, 0) + 1
        missing -= left[p] == 1
        while not missing:
            if best is None or at[b] - at[a] < best[1] - best[0]:
                best = (int(at[a]), int(at[b]))
            left[int(place[a])] -= 1
            missing += left[int(place[a])] == 0
            a += 1
    return best


def _verified(hashes: np.ndarray, lib: Library, s: Scale, start: np.ndarray, end: np.ndarray, t: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
    """Matches with their tight spans (first shingle, last shingle); of overlapping ones the fullest, then the first.

    A match reaches no further than its template's own length, so copies that follow
    each other are told apart. Only a window that holds the threshold's share in no
    such span, as words stand between, gives the shortest span with what it holds.
    """
    for k, name in enumerate(s.names):
        wanted, least = lib.shingles[name], lib.containment - 1e-9
        windows = []
        for a, b in zip(start[t == k], end[t == k], strict=True):
            place = np.minimum(np.searchsorted(wanted, hashes[a:b]), len(wanted) - 1)
            inside = np.flatnonzero(wanted[place] == hashes[a:b])
            if len(np.unique(place[inside])) / len(wanted) >= least:
                windows.append((a + inside, place[inside]))
        if not windows:
            continue
        at, first = np.unique(np.concatenate([x for x, _ in windows]), return_index=True)
        place = np.concatenate([p for _, p in windows])[first]
        found = set()
        for begin in np.unique(at - lib.places[name][place]):  # where a copy that holds the shingle begins
            a, b = np.searchsorted(at, (begin, begin + lib.lengths[name]))
            share = len(np.unique(place[a:b])) / len(wanted)
            if share >= least:
                found.add((-share, int(at[a]), int(at[b - 1])))
        taken = _Taken(lib.width)
        for share, a, b in sorted(found):
            if taken.add(a, b):
                yield name, a, b, -share
        found = set()
        for near, p in windows:
            gaps = taken.gaps(near)
            for gap in np.unique(gaps[gaps >= 0]):
                share = len(np.unique(p[gaps == gap])) / len(wanted)
                if share >= least:
                    found.add((-share, *_shortest(near[gaps == gap], p[gaps == gap])))
        for share, a, b in sorted(found):
            if taken.add(a, b):
                yield name, a, b, -share


def _short(words: Words, lib: Library) -> Iterator[tuple[int, str, int, int]]:
    """Text, template and words of each place where a template of fewer words than a shingle stands whole."""
    for width, names in lib.short.items():
        hashes, bound = words.shingles(width)
        at = np.flatnonzero(np.isin(hashes, np.array(list(names), dtype=np.uint64)))
        free: dict[str, int] = {}
        for i, text in zip(at.tolist(), (np.searchsorted(bound, at, side="right") - 1).tolist(), strict=True):
            for name in names[int(hashes[i])]:
                if i >= free.get(name, 0):  # the first of overlapping ones
                    free[name] = min(i + width, int(bound[text + 1]))
                    yield text, name, i - int(bound[text]), i - int(bound[text]) + width


def _scanned(batches: Iterator[pa.RecordBatch], lib: Library) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = normalized(batch.column("text")), []
        for at, to in slices(texts):
            words = words_of(texts.slice(at, to - at))
            hashes, bound = words.shingles(lib.width)
            if not len(hashes):
                continue

            def told(text: int, name: str, first: int, last: int, share: float, words=words, at=at) -> None:
                span = slice(words.starts[words.first[text] + first], words.ends[words.first[text] + last - 1])
                out.append((at + text, name, first, last, share, words.data[span].tobytes().decode()))

            for text, name, first, last in _short(words, lib):
                told(text, name, first, last, 1.0)
            for s, start, end, t in _retrieved(hashes, bound, lib):
                owner = np.searchsorted(bound, start, side="right") - 1
                for text in np.unique(owner):
                    own = owner == text
                    total = int(words.first[text + 1] - words.first[text])
                    for name, a, b, share in _verified(hashes, lib, s, start[own], end[own], t[own]):
                        first = int(a - bound[text])
                        told(int(text), name, first, min(int(b - bound[text]) + lib.width, total), share)
        if out:
            rows, *columns = zip(*out, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "template", "start_word", "end_word", "containment", "matched"])


def license_scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """Find license wordings in whole texts: one row a match.

    Columns: ``id_col``, template, start_word and end_word (half-open, in words of
    the text: runs of letters and digits), containment (share of the template's
    distinct word shingles found in one window) and matched (the words, lower-cased).
    Matches of one template that share words give one row, the fullest, then the
    first; copies that follow each other give a row each. By default all
    ``TEMPLATES`` and ``NOTICES`` are looked for.

    A template of fewer than ``width`` words is one shingle of all its words and
    matches wherever they stand, unchanged. Null and empty texts match nothing. Null ids pass
    through; rows that repeat an id are scanned one by one. An empty table gives
    no rows. Other columns of ``df`` don't matter. One pass, nothing is shuffled;
    the templates are the caller's own list and travel with the tasks.
    """
    lib = library(TEMPLATES | NOTICES if templates is None else templates, width, containment)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(lambda b: _scanned(b, lib), f"id {kind}, template string, start_word long, end_word long, containment double, matched string")
    return found.withColumnRenamed("id", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    """License wordings in all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
