"""Licence scan: passages compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised (lower case, marks and copyright lines out,
"licence" spelt with an s).  Dice(A, B) = 2 |A & B| / (|A| + |B|) over distinct
bigrams.  From Dice >= t follow the size bounds ``t m / (2 - t) <= |A| <=
(2 - t) m / t`` for a template of m bigrams, and |A & B| >= t m / (2 - t): a
document with fewer of a template's bigrams never meets it, and a passage longer
than the bound is not extended.  A best passage starts and ends at a shared
bigram, so only those places are tried; this loses nothing.  Nor does ending when
the shared bigrams left cannot give a higher score.  Templates are an argument;
documents are scanned where they are, without a shuffle.  Near templates (BSD-2
and BSD-3, versions of a notice) may both match; the higher score tells which.

Defined results: a null, empty or licence-free text gives no row; of passages
equal in score the earliest, then shortest counts; repeated rows are scanned
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverylens.llm.common import ByteTexts, documents, shingle_hashes, slices
from deliverylens.llm.license_texts import ISC_END, MIT_END, all_texts

DICE = 0.85
MARKS = b".,;:!?#$%&*|\"'()[]<>/-_`"
# Whole texts, short forms and notices of public licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    "MIT-line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. """ + MIT_END,
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. """ + ISC_END,
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
TEMPLATES = {**TEMPLATES, **all_texts()}
_COPYRIGHT = re.compile(rb"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|\xc2\xa9)[^\n]*(?:\n|$)")


def normal_words(text: bytes) -> list[bytes]:
    """Normalised words of a text."""
    text = text.lower()
    if b"copyright" in text or b"(c)" in text or b"\xc2\xa9" in text:
        text = _COPYRIGHT.sub(b"", text)
    if b"licence" in text:
        text = text.replace(b"licence", b"license")
    return text.split()


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, dice: float = DICE):
        self.known: dict[bytes, int] = {}
        self.dice, self.names = dice, list(templates)
        self.sets = [np.unique(shingle_hashes(self.hashes(normal_words(t.encode())), 2)) for t in templates.values()]
        m = np.array([len(s) for s in self.sets])
        self.low = np.array([math.ceil(dice * x / (2 - dice) - 1e-9) for x in m])
        self.high = np.array([math.floor((2 - dice) * x / dice + 1e-9) for x in m])
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(m)), m)
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner = flat[order], owner[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.gram >> np.uint64(48)).astype(np.int64)] = True

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            p = w.strip(MARKS)
            known[w] = (xxhash.xxh3_64_intdigest(p) or 1) if p else 0
        out = np.array(list(map(known.__getitem__, words)), np.uint64)
        return out[out != 0]

    def __call__(self, texts: list[bytes]) -> list[tuple[int, str, float, int, int]]:
        """(text, template, dice, start word, number of words): best passage of each text and template."""
        docs = [self.hashes(normal_words(t)) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        begin = np.cumsum(size) - size
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        if len(flat) < 2:
            return []
        g = shingle_hashes(flat, 2)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        doc = np.searchsorted(begin, at, "right") - 1
        ok = (hi > lo) & (at + 2 <= (begin + size)[doc])
        at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
        n = hi - lo
        rep = np.repeat(np.arange(len(at)), n)
        owner = self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[rep]]
        pair = doc[rep] * len(self.names) + owner
        order = np.lexsort((at[rep], pair))
        pair, place = pair[order], at[rep][order]
        out = []
        edges = np.flatnonzero(np.diff(pair, prepend=-1))
        for x, y in zip(edges, np.append(edges[1:], len(pair))):
            d, t = divmod(int(pair[x]), len(self.names))
            here = place[x:y]
            if len(np.unique(g[here])) < self.low[t]:
                continue
            found = self._best(g, here, int(begin[d] + size[d]) - 1, t)
            if found:
                out.append((d, self.names[t], found[0], found[1] - int(begin[d]), found[2]))
        return out

    def _best(self, g: np.ndarray, places: np.ndarray, end: int, t: int):
        """Best (dice, start, words) among passages from one shared bigram to another within the size bound."""
        m, best = len(self.sets[t]), None
        # distinct shared bigrams from each place on
        left = np.cumsum(np.isin(np.arange(len(places)), len(places) - 1 - np.unique(g[places][::-1], return_index=True)[1])[::-1])[::-1]
        for i, a in enumerate(places):
            if left[i] < self.low[t] or (best is not None and 2 * left[i] / (left[i] + m) <= best[0]):
                break
            seen, common = set(), set()
            at = a
            for b in places[i:]:
                seen.update(g[at:b + 1].tolist())
                at = b + 1
                if len(seen) > self.high[t]:
                    break
                common.add(int(g[b]))
                dice = 2 * len(common) / (len(seen) + m)
                if dice >= self.dice and (best is None or dice > best[0]):
                    best = (dice, int(a), int(b - a) + 2)
        return best


def scan_licenses(docs: DataFrame, dice: float = DICE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, start_word, n_words): each document and template (name: text) that a passage of it matches."""

    def run(batches):
        scanner = Scanner(templates, dice)
        for batch in batches:
            raw = ByteTexts(batch.column(1))
            for lo, hi in slices(batch.column(1)):
                got = scanner([raw[i] for i in range(lo, hi)])
                if got:
                    d, name, score, start, n = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([lo + x for x in d])), pa.array(name), pa.array(score, pa.float64()),
                         pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "license", "dice", "start_word", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, dice double, start_word long, n_words long")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
