"""License scans by a trained paragraph classifier.

A paragraph is a block of lines between blank lines, read as one run of words, so hard-wrapped notices are whole. Every
window of it (of REACH words, or twice the template's if that is more) that holds MIN_SHARE of a template's word bigrams
is a candidate, as a sparse bag of hashed word n-grams (n from 1 to 3). A multinomial logistic regression with one class
for every licence family and one for `unknown` gives probabilities, calibrated by one temperature that is fitted on
held-out paragraphs; the class `unknown` is learned from ordinary paragraphs and from near misses (shuffled and mixed
notices), so a window that is merely about software isn't forced into a family. A candidate is confirmed where its own
family reaches MIN_PROB. Several notices in one paragraph or line are each found.

Training paragraphs are made from the templates below (public wordings of notices) by dropping, swapping and adding
words, and from about ``windows`` windows of at most REACH words, picked by hashes from whole texts of about ``sample``
documents; those without any licence word or template are the ordinary ones. A scan leaves out nothing by words of its
own: what passes a text by is that it holds MIN_SHARE of no template, which the confirmation asks for anyway.

Edge cases: null and empty texts have no paragraph and an empty result; a document may hold several families, listed in
order of name; repeated rows get equal results; very long paragraphs are read whole, window by window; with an empty table the model
learns from the templates alone; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed

BUCKETS = 1 << 14
MIN_PROB = 0.5
MIN_SHARE = 0.6
SAMPLE = 400
WINDOWS = 2000
UNKNOWN = "unknown"
REACH = 80
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
_BLANK = re.compile(r"\r?\n(?:[^\S\n]*\n)+")
_HINT = re.compile(r"licen[sc]e|copyright|warrant|redistribut|permission|all rights|public domain|creative commons|spdx|\bcc[ -]by|\bcc0\b|\bmit\b|\bgpl\b|\bagpl\b|\blgpl\b|\bbsd\b|apache|mozilla|\bisc\b|unlicense", re.I)

TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying is prohibited."),
}


def paragraphs(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every block of lines between blank lines, in code points."""
    text, out, at = text or "", [], 0
    for gap in _BLANK.finditer(text):
        out.append((at, gap.start()))
        at = gap.end()
    return [(a, b) for a, b in (*out, (at, len(text))) if not text[a:b].isspace() and a < b]


def words(paragraph: str) -> list[str]:
    return " ".join(_WORD.findall(paragraph)).lower().split()


def bucket(gram: str) -> int:
    return crc32(gram.encode()) % BUCKETS


def features(tokens: list[str]) -> np.ndarray:
    """Distinct hashed n-grams of a paragraph."""
    grams = [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    return np.unique(np.fromiter((bucket(g) for g in grams), np.int64, len(grams)))


def _varied(template: str, rng: random.Random, filler: list[str]) -> list[str]:
    out = []
    for w in words(template):
        roll = rng.random()
        if roll < 0.06:
            continue
        out.append(rng.choice(filler) if roll < 0.08 else w)
        if roll > 0.96:
            out.append(rng.choice(filler))
    side = [rng.choice(filler) for _ in range(rng.choice((0, 0, 2, 6, 15)))]
    cut = rng.randint(0, len(side))
    return side[:cut] + out + side[cut:]


class Model:
    """Weights (BUCKETS x classes), biases, the temperature and the templates' bigrams."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, min_share: float = MIN_SHARE):
        self.classes, self.weights, self.bias, self.temperature, self.min_share = classes, weights, bias, temperature, min_share
        self.useful = set(np.flatnonzero(np.abs(weights).sum(axis=1) > 0).tolist())
        #: (family, bigrams, most words of a window) of every template, and the templates that hold each bigram.
        self.flat = [(f, set(zip(w, w[1:], strict=False)), max(REACH, 2 * len(w))) for f, t in TEMPLATES.items() for w in map(words, t)]
        self.holders: dict[tuple, list[int]] = {}
        for n, (_, grams, _) in enumerate(self.flat):
            for g in grams:
                self.holders.setdefault(g, []).append(n)

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        at = features(tokens)
        z = (self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at))) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def candidates(self, tokens: list[str]) -> list[tuple[float, int, str, int, int]]:
        """(share, held bigrams, family, first, last + 1 word) of every window of at most ``reach`` words that holds
        min_share of a template's distinct bigrams, from the first to the last of them; windows of one template don't
        overlap."""
        hits: dict[int, list[tuple[int, tuple]]] = {}
        for i, gram in enumerate(zip(tokens, tokens[1:], strict=False)):
            for t in self.holders.get(gram, ()):
                hits.setdefault(t, []).append((i, gram))
        out = []
        for t, found in hits.items():
            family, grams, reach = self.flat[t]
            need, i, j = max(1, ceil(self.min_share * len(grams) - 1e-9)), 0, 0
            held: Counter = Counter()
            if len({g for _, g in found}) < need:
                continue
            while j < len(found):
                at, gram = found[j]
                held[gram] += 1
                j += 1
                while at + 2 - found[i][0] > reach or held[found[i][1]] > 1:
                    held[found[i][1]] -= 1
                    if not held[found[i][1]]:
                        del held[found[i][1]]
                    i += 1
                if len(held) < need:
                    continue
                last = at
                for k in range(j, len(found)):
                    if found[k][0] + 2 - found[i][0] > reach or len(held) == len(grams):
                        break
                    if found[k][1] not in held:
                        held[found[k][1]] += 1
                        last, j = found[k][0], k + 1
                inside = Counter(g for _, g in found[i:j])
                while inside[found[i][1]] > 1:
                    inside[found[i][1]] -= 1
                    i += 1
                out.append((len(held) / len(grams), len(held), family, found[i][0], last + 2))
                held, i = Counter(), j
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, template share, start, end) of every confirmed notice.

        Of windows that overlap, the one that agrees best with its template goes first."""
        out = []
        text = text or ""
        for start, end in paragraphs(text):
            block = text[start:end]
            tokens = words(block)
            tried = self.candidates(tokens)
            if not tried:
                continue
            at, taken = [m.span() for m in _WORD.finditer(block)], []
            for share, _, family, i, j in sorted(tried, key=lambda c: (-c[0], -c[1], c[3], c[2])):
                if any(i < b and a < j for a, b in taken):
                    continue
                p = self.probabilities(tokens[max(0, i - 1) : j + 1])
                k = int(p.argmax())
                if self.classes[k] == family and p[k] >= MIN_PROB:
                    taken.append((i, j))
                    a, b = at[i][0], at[j - 1][1]
                    while a and not block[a - 1].isspace():
                        a -= 1
                    while b < len(block) and not block[b].isspace():
                        b += 1
                    out.append((family, float(p[k]), share, start + a, start + b))
        return sorted(out, key=lambda f: f[3])


def train(ordinary: list[str], seed: int = 11, a_family: int = 240) -> Model:
    """Fit on varied templates and ordinary paragraphs; a fifth is held out for the temperature."""
    rng = random.Random(seed)
    common = sorted({w for t in TEMPLATES.values() for x in t for w in words(x)})
    filler = sorted({w for p in ordinary for w in words(p)}) or ["the", "of", "and", "text", "this", "page", "for"]
    classes = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[list[str], int]] = []
    for k, family in enumerate(TEMPLATES):
        rows += [(_varied(rng.choice(TEMPLATES[family]), rng, filler), k) for _ in range(a_family)]
    unknown = len(classes) - 1
    rows += [(words(p), unknown) for p in ordinary]
    rows += [(rng.sample(common, rng.randint(1, 12)) + [rng.choice(filler) for _ in range(rng.randint(0, 12))], unknown) for _ in range(2 * a_family)]
    rows += [([rng.choice(filler) for _ in range(rng.randint(1, 30))], unknown) for _ in range(2 * a_family)]
    rng.shuffle(rows)
    xs, y = [features(t) for t, _ in rows], np.array([k for _, k in rows])
    cut = len(rows) * 4 // 5
    weights, bias, squares = np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), np.full((BUCKETS, 1), 1e-6)
    order = list(range(cut))
    for epoch in range(6):
        rng.shuffle(order)
        for i in order:
            at, scale = xs[i], 1 / np.sqrt(max(1, len(xs[i])))
            z = weights[at].sum(axis=0) * scale + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            squares[at] += (p @ p) * scale**2
            weights[at] -= 0.5 * scale * p / np.sqrt(squares[at])
            bias -= 0.02 * p
    held = [(weights[xs[i]].sum(axis=0) / np.sqrt(max(1, len(xs[i]))) + bias, y[i]) for i in range(cut, len(rows))]
    loss = lambda t: sum(np.log(np.exp((z - z.max()) / t).sum()) - (z[k] - z.max()) / t for z, k in held)
    return Model(classes, weights, bias, float(min(np.geomspace(0.1, 10.0, 93), key=loss)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = text.as_py().split()
            parts = [" ".join(tokens[i : i + REACH]) for i in range(0, len(tokens), REACH)]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["h", "i", "words"])


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """Learn with ordinary windows: about ``sample`` different documents are picked by a hash of id and text, their whole
    texts cut into windows of REACH words, and about ``windows`` of these picked by a hash. They only serve as background."""
    n = docs.count()
    part = lambda most, of: min(1.0, most / max(1, of)) * (1 << 20)
    chosen = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where("text IS NOT NULL").where(F.pmod("h", F.lit(1 << 20)) < part(sample, n)).dropDuplicates(["h"])
    cut = checkpointed(chosen.mapInArrow(_windows, "h long, i long, words string"))
    lines = cut.where(F.pmod(F.xxhash64("h", "i"), F.lit(1 << 20)) < part(windows, cut.count())).select("words")
    bare = Model([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    notice = lambda line: _HINT.search(line) or bare.candidates(words(line))
    return train(sorted(r["words"] for r in lines.collect() if not notice(r["words"])))


OUT = "doc_id long, families string, n_confirmed long, best_family string, best_probability double, spans string"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """For every row: the confirmed families, joined by commas in order of name, the number of confirmed paragraphs, the
    most probable one, and family:start:end of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = model.scan(text.as_py())
                best = max(found, key=lambda f: (f[1], f[0]), default=(UNKNOWN, 0.0))
                rows.append((doc_id, ",".join(sorted({f[0] for f in found})), len(found), best[0], best[1], ",".join(f"{f[0]}:{f[3]}:{f[4]}" for f in found)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, OUT)
