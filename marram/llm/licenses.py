"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of m shingles is looked for in windows of whole blocks of ``stride`` shingles, one window a block,
long enough to hold it wherever it lies. At least two fifths of the united shingles of a window and a template
that it holds to ``PERCENT`` are shared (half, if it holds it whole), so that with ``BANDS`` bands of one value
each, a match is missed with a chance under 1e-6. All windows are built from the same block minima. Templates whose
windows have the same shape share a band table, sorted by value: a window is looked up in it, whatever the number of
templates. Shapes are few: about three for each doubling of a template's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared
from .decontaminate import words_of

SHINGLE, PERCENT, BANDS = 5, 80, 32
#: Words of templates that are sent to the executors at once; more templates take more passes.
PASS_WORDS = 1_000_000
#: Shingles of texts that are permuted at once: a longer text is cut into overlapping pieces.
AT_ONCE = 1 << 15
_KEPT = 200_000

#: Texts that declare a license, as their publishers word them. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word, 1)
        return out


def _shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles of a word sequence, in order."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_shared.kept("license words", _WordHashes).__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


@lru_cache(None)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.integers(0, 2**31, (BANDS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (BANDS, 1)).astype(np.uint32)


def window_of(m: int) -> tuple[int, int]:
    """(stride, length) in shingles of the windows for a template of m shingles."""
    stride = 2
    while stride * 4 <= m:
        stride *= 2
    return stride, -(-(m + stride - 1) // stride) * stride


@dataclass
class _Shape:
    """The templates whose windows have one shape, and their band table: by band, sorted values and whose they are."""

    stride: int
    length: int
    names: list[str]
    hashes: list[np.ndarray]
    values: np.ndarray
    owners: np.ndarray


def _prepare(templates: list[tuple[str, str | None]]) -> list[_Shape]:
    """Templates (name, text) by shape; those of fewer words than a shingle hold nothing and are left out."""
    a, b = _permutations()
    shapes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates, key=lambda t: (t[0], t[1] or "")):
        hashes = np.unique(_shingles(words_of(text)))
        if not len(hashes):
            continue
        shapes.setdefault(window_of(len(hashes)), []).append((name, hashes))
    out = []
    for (stride, length), own in sorted(shapes.items()):
        least = np.stack([(a * (h >> np.uint64(32)).astype(np.uint32) + b).min(1) for _, h in own], 1)
        owners = np.argsort(least, axis=1, kind="stable")
        out.append(_Shape(stride, length, [n for n, _ in own], [h for _, h in own], np.take_along_axis(least, owners, 1), owners))
    return out


def _candidates(window: np.ndarray, shape: _Shape) -> np.ndarray:
    """(window, template) pairs that share a band, by looking each window's values up in the band table."""
    found = []
    for values, owners, own in zip(shape.values, shape.owners, window, strict=True):
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        hit = np.flatnonzero(last > first)
        n = last[hit] - first[hit]
        at = np.arange(n.sum()) + np.repeat(first[hit] - (np.cumsum(n) - n), n)
        found.append(np.stack([np.repeat(hit, n), owners[at]], 1))
    return np.unique(np.concatenate(found), axis=0)


def _find(docs: list[np.ndarray], shapes: list[_Shape], pad: int) -> list[set[str]]:
    """Names of the templates found in each document (shingle hashes)."""
    found: list[set[str]] = [set() for _ in docs]
    starts = np.cumsum([0] + [-(-len(d) // pad) * pad for d in docs])
    total = int(starts[-1])
    if not total or not shapes:
        return found
    x, real = np.zeros(total, np.uint32), np.zeros(total, bool)
    for at, d in zip(starts.tolist(), docs, strict=False):
        x[at : at + len(d)] = (d >> np.uint64(32)).astype(np.uint32)
        real[at : at + len(d)] = True
    a, b = _permutations()
    y = a * x + b
    y[:, ~real] = 2**32 - 1
    minima, stride = {}, 1
    while stride < max(s.stride for s in shapes):
        y = np.minimum(y[:, ::2], y[:, 1::2])
        stride *= 2
        minima[stride] = y
    for s in shapes:
        blocks = minima[s.stride]
        window = blocks
        n = blocks.shape[1]
        for k in range(1, min(s.length // s.stride, n)):  # windows at the end are shorter: they keep the blocks reached so far
            window = np.concatenate([np.minimum(window[:, : n - k], blocks[:, k:]), window[:, n - k :]], axis=1)
        for w, t in _candidates(window, s).tolist():
            d = int(np.searchsorted(starts, w * s.stride, "right")) - 1
            own = docs[d][w * s.stride - starts[d] :][: s.length]
            if s.names[t] not in found[d] and 100 * len(np.intersect1d(own, s.hashes[t])) >= PERCENT * len(s.hashes[t]):
                found[d].add(s.names[t])
    return found


def _scan(templates: list[tuple[str, str | None]]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = _prepare(templates)
        pad, reach = max((s.stride for s in ready), default=1), max((s.length for s in ready), default=0)
        step = -(-AT_ONCE // pad) * pad
        for texts in batches:
            out: list[set[str]] = [set() for _ in range(len(texts))]
            docs, of, n = [], [], 0

            def look(out=out) -> None:
                for i, found in zip(of, _find(docs, ready, pad), strict=True):
                    out[i] |= found
                docs.clear()
                of.clear()

            for i, text in enumerate(texts):
                own = _shingles(words_of(text.as_py()))
                # A long text comes in pieces that begin at blocks of any shape and overlap by the longest window.
                for first in range(0, len(own), step):
                    docs.append(own[first : first + step + reach])
                    of.append(i)
                    n += len(docs[-1])
                    if n > AT_ONCE:  # bounds the table of permuted values
                        look()
                        n = 0
            look()
            yield pa.array([sorted(s) for s in out], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()


def _passes(templates: dict[str, str] | DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Templates (name, text) in passes of bounded size; a table is never all on the driver if it is long."""
    items = templates.items() if isinstance(templates, dict) else templates.where("name IS NOT NULL").select("name", "text").distinct().toLocalIterator()
    found, n = [], 0
    for name, text in items:
        found.append((name, text))
        n += len(words_of(text))
        if n >= PASS_WORDS:
            yield found
            found, n = [], 0
    if found:
        yield found


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` and ``_licenses``: the names of the templates that a whole text holds, sorted.

    ``templates`` are texts by name, or a table (name, text). A name of several texts is found where any of them is; null
    texts, and those of fewer words than a shingle, are found nowhere; rows without a name are left out. A window holds a template if ``PERCENT`` of
    the template's distinct word shingles are in it. Null texts and those of fewer words than a shingle hold none; without
    templates, nothing does. Repeated rows are scanned alike; a column named ``_licenses`` is replaced, all others are kept.
    """
    _shared.bounded_batches(docs.sparkSession)
    text, none = F.col("text").cast("string"), F.array().cast("array<string>")
    found: list[Column] = [_scan(some)(text) for some in _passes(templates)]
    return docs.drop("_licenses").withColumn("_licenses", F.array_sort(F.array_distinct(F.concat(none, *found))))


def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_shared.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("_licenses").cast("long").alias("n_licenses"), F.array_join("_licenses", ",").alias("licenses"))


def _template_rows() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        words = [w.decode() for w in words_of(text)]
        own = sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
        stride, length = window_of(len(own))
        rows += [f"('{name}', {len(own)}, {stride}, {length}, '{k}')" for k in own]
    return ", ".join(rows)


OP9_SQL = f"""
WITH t(name, m, stride, length, k) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM d)),
h AS (SELECT doc_id, name, m, k, unnest(range(greatest(0, CAST(floor((i - length) / stride) AS BIGINT) + 1), i // stride + 1)) AS w FROM s JOIN t USING (k)),
f AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, name, m, w FROM h GROUP BY ALL HAVING 100 * count(DISTINCT k) >= {PERCENT} * m)),
g AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)
"""
