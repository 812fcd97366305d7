"""Licence scans by a trained paragraph classifier (operator 9).

A paragraph is a line, or neighbouring lines without a blank one between them that hold a notice together: a run whose
share of a template is above that of each of its lines. Its features are the word n-grams, up to three words, that occur in the templates below; a
multinomial logistic regression in numpy learns families from variations of the templates and `none` from paragraphs of
the corpus. Probabilities are tempered, and the threshold under which a licence-like paragraph is called `unknown` is
set, on variations held out from training. A family is reported where a template of it confirms the prediction by the
share of its n-grams that the paragraph has; a prediction without such a template is `unknown` too.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, ship

# Notices and telling sentences of public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Licensed under the Simplified BSD License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without prior written permission of the publisher.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Wordings that introduce a licence, and names of licences that no family above has, for variations.
OPENINGS = ["licensed under the", "released under the", "this work is licensed under the", "distributed under the", "available under the", "this file is licensed under the"]
OTHERS = ["Eclipse Public License", "Open Software License", "Artistic License", "Zope Public License", "European Union Public Licence", "Academic Free License", "Boost Software License", "Community Data License"]

NONE, UNKNOWN = "none", "unknown"
NEWLINE = b"\x01"
#: ASCII letters lowered; other ASCII but digits becomes a space; non-ASCII bytes stay.
CLEAN = bytes(b if b > 127 or b == 1 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
#: Share of a template's n-grams that a paragraph must have.
CONFIRMED = 0.6
#: By how much a run of lines must hold more of a template than each line alone, unless the template crosses its newlines; words that a run may have for each of a template.
BETTER, LOOSE = 0.1, 2


def words(text: str) -> list[bytes]:
    return text.encode().replace(NEWLINE, b" ").translate(CLEAN).split()


def ngrams(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def shares(own: set, templates: list[tuple[str, set]]) -> np.ndarray:
    return np.array([len(own & g) / len(g) for _, g in templates])


def runs(lines: list[list[bytes]], templates: list[tuple[str, set]]) -> list[tuple[int, int]]:
    """Runs [i, j) of lines of a block that hold a notice together, the longest notice first; none overlap."""
    every = set().union(*(g for _, g in templates))
    sizes = np.array([len(g) for _, g in templates])
    longest = LOOSE * max(sum(len(x) == 1 for x in g) for _, g in templates)
    family = np.array([f for f, _ in templates])
    other = family[:, None] != family
    alone = [shares(ngrams(x), templates) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if not any((w,) in every for w in line):
            continue
        found.append((-int((alone[i] * sizes)[alone[i] >= CONFIRMED].max(initial=0)), 1, i))
        tokens, most, single, joint = list(line), 0, alone[i], True
        for j in range(i + 1, len(lines)):
            joint = joint & np.array([(*tokens[-1:], *lines[j][:1]) in g for _, g in templates])
            tokens += lines[j]
            if len(tokens) > longest:
                break
            single = np.maximum(single, alone[j])
            share = shares(ngrams(tokens), templates)
            # Clearly more of a template than a line has, or more where the template goes on from line to line; and no less
            # than a line has of another family's.
            fit = (share >= CONFIRMED) & ((share >= single + BETTER) | joint & (share > single)) & (share >= np.where(other, single, 0).max(1))
            held = int(np.rint((share * sizes)[fit]).max(initial=0))
            if held > most:
                most = held
                found.append((-held, j + 1 - i, i))
    out, taken = [], set()
    for held, n, i in sorted(found):
        if held and taken.isdisjoint(range(i, i + n)):
            taken.update(range(i, i + n))
            if n > 1:
                out.append((i, i + n))
    return out


def plain_lines(text: str, templates: list[tuple[str, set]]) -> list[str]:
    """Lines of a text that aren't blank, without the wrapped notices."""
    out: list[str] = []
    block: list[str] = []
    for x in [*text.split("\n"), ""]:
        if words(x):
            block.append(x)
        else:
            tokens = [words(b) for b in block]
            if len(block) > 1 and shares(ngrams([w for t in tokens for w in t]), templates).max() >= CONFIRMED:
                gone = {k for i, j in runs(tokens, templates) for k in range(i, j)}
                block = [b for k, b in enumerate(block) if k not in gone]
            out += block + [x] * bool(x.strip())
            block = []
    return out


def template_sets() -> list[tuple[str, set]]:
    return [(family, ngrams(words(t))) for family, texts in TEMPLATES.items() for t in texts]


class Scanner:
    def __init__(self, plain: list[str], seed: int = 3, steps: int = 250):
        """plain: paragraphs of the corpus, from which those that a template would confirm are left out."""
        self.templates = template_sets()
        self.families = [NONE, UNKNOWN, *TEMPLATES]
        # Features: every n-gram of the templates and openings, found along three tables of word, pair and triple.
        grams = set().union(*(g for _, g in self.templates), *(ngrams(words(x)) for x in OPENINGS))
        self.word = {g[0]: i for i, g in enumerate(sorted(g for g in grams if len(g) == 1), 1)}
        pairs, triples = (sorted(g for g in grams if len(g) == n) for n in (2, 3))
        size = len(self.word) + 1
        self.pair = np.zeros((size, size), np.int32)
        for i, (a, b) in enumerate(pairs, 1):
            self.pair[self.word[a], self.word[b]] = i
        self.triple = np.zeros((len(pairs) + 1, size), np.int32)
        for i, (a, b, c) in enumerate(triples, 1):
            self.triple[self.pair[self.word[a], self.word[b]], self.word[c]] = i
        self.bases = (0, size, size + len(pairs) + 1)
        self.width = size + len(pairs) + len(triples) + 2
        self.holds = np.zeros((self.width, len(self.templates)), np.float32)
        for t, (_, own) in enumerate(self.templates):
            for n, ids in enumerate((((g, self.word[g[0]]) for g in own if len(g) == 1), ((g, i) for i, g in enumerate(pairs, 1) if g in own), ((g, i) for i, g in enumerate(triples, 1) if g in own))):
                for _, i in ids:
                    self.holds[i + self.bases[n], t] = 1 / len(own)
        self._fit(plain, random.Random(seed), steps)

    def features(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stream of words with NEWLINE between paragraphs: distinct (paragraph, feature) pairs and words by paragraph."""
        get = self.word.get
        u = np.fromiter((get(w, 0) if w != NEWLINE else -1 for w in tokens), np.int32, len(tokens))
        line = np.cumsum(u < 0)
        size = np.bincount(line[u >= 0], minlength=int(line[-1]) + 1 if len(line) else 1)
        return *self._found(u[u >= 0], line[u >= 0]), size

    def _found(self, known: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (line, feature) pairs of words given by number and line."""
        found = [(known, line)]
        if len(known) > 1:
            p = self.pair[known[:-1], known[1:]] * (line[:-1] == line[1:])
            found.append((p, line[:-1]))
            if len(known) > 2:
                found.append((self.triple[p[:-1], known[2:]] * (line[1:-1] == line[2:]), line[:-2]))
        codes = [at[f > 0].astype(np.int64) * self.width + f[f > 0] + base for (f, at), base in zip(found, self.bases, strict=False)]
        codes = np.unique(np.concatenate(codes))
        return codes // self.width, codes % self.width

    def blocks(self, tokens: list[bytes], ends: np.ndarray) -> list[tuple[int, int]]:
        """Blocks of several lines [first, last] that together hold enough of a template; ends: the last line of each text."""
        get = self.word.get
        u = np.fromiter((get(w, 0) if w != NEWLINE else -1 for w in tokens), np.int32, len(tokens))
        line = np.cumsum(u < 0)
        size = np.bincount(line[u >= 0], minlength=int(line[-1]) + 1)
        new = size == 0
        new[ends + 1] = True
        block = np.cumsum(new)
        at, feature = self._found(u[u >= 0], block[line[u >= 0]])
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        if not len(starts):
            return []
        held = np.add.reduceat(self.holds[feature], starts, axis=0).max(1)
        filled = np.flatnonzero(size > 0)
        out = []
        for b in at[starts[held >= CONFIRMED - 1e-4]]:
            own = filled[np.searchsorted(block[filled], b) : np.searchsorted(block[filled], b, side="right")]
            if len(own) > 1:
                out.append((int(own[0]), int(own[-1])))
        return out

    def logits(self, line: np.ndarray, feature: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row for each paragraph that has a feature; features weigh less in longer paragraphs."""
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        sums = np.add.reduceat(self.weights[feature], starts, axis=0) if len(starts) else np.zeros((0, len(self.families)))
        return sums / np.sqrt(np.maximum(size[line[starts]], 4))[:, None] * self.scale + self.bias

    def _variations(self, draw: random.Random, plain: list[list[bytes]]) -> tuple[list[list[bytes]], list[int]]:
        texts, labels = [], []
        for k, family in enumerate(self.families[2:], 2):
            for template in TEMPLATES[family]:
                own = words(template)
                for _ in range(60 // len(TEMPLATES[family]) + 10):
                    kept = [w for w in own if draw.random() > 0.03] if len(own) > 8 else list(own)
                    around = draw.choice(plain) if plain and draw.random() < 0.4 else []
                    n = draw.randrange(0, 7)
                    texts.append(around[:n] + kept + around[n : n + draw.randrange(0, 5)])
                    labels.append(k)
        for _ in range(400):
            texts.append(words(f"{draw.choice(OPENINGS)} {draw.choice(OTHERS)} {draw.choice(['', 'version 1.0', 'version 2', 'v3'])}"))
            labels.append(1)
        for x in plain:
            texts.append(x)
            labels.append(0)
        return texts, labels

    def _design(self, texts: list[list[bytes]]) -> np.ndarray:
        x = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            _, feature, size = self.features(t) if t else ([], np.zeros(0, int), [0])
            x[i, feature] = self.scale / math.sqrt(max(size[0], 4))
        return x

    def _fit(self, plain: list[str], draw: random.Random, steps: int) -> None:
        self.scale = 2.0
        tokens = [t for t in map(words, plain) if t and not any(self.share(ngrams(t), g) >= CONFIRMED / 2 for _, g in self.templates)]
        texts, labels = self._variations(draw, tokens)
        order = list(range(len(texts)))
        draw.shuffle(order)
        held = set(order[: len(order) // 5])
        fit = [i for i in range(len(texts)) if i not in held]
        y = np.array(labels)
        x = self._design([texts[i] for i in fit])
        target = np.eye(len(self.families), dtype=np.float32)[y[fit]]
        weight = (len(fit) / np.maximum(target.sum(0), 1) / len(self.families))[y[fit]][:, None].astype(np.float32)
        w, b = np.zeros((self.width, len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        speed, rest = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            grad = weight * (softmax(x @ w + b) - target) / len(fit)
            speed = 0.9 * speed - 2.0 * (x.T @ grad + 1e-5 * w)
            rest = 0.9 * rest - 2.0 * grad.sum(0)
            w, b = w + speed, b + rest
        self.weights, self.bias = w, b
        # Calibration on what was held out: a temperature, and the top probability that 98 % of true families reach.
        keep = sorted(held)
        z, truth = self._design([texts[i] for i in keep]) @ w + b, y[keep]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        p = softmax(z / self.temperature)
        right = (truth > 1) & (p.argmax(1) == truth)
        self.least = float(min(0.9, np.quantile(p[right].max(1), 0.02))) if right.any() else 0.5
        self.accuracy = float((p.argmax(1) == truth).mean())

    @staticmethod
    def share(paragraph: set, template: set) -> float:
        return len(paragraph & template) / len(template)

    def verdict(self, tokens: list[bytes], p: np.ndarray) -> tuple[str, float]:
        """Family of a paragraph that is licence-like, and its probability."""
        k = int(p[2:].argmax()) + 2
        own, name = ngrams(tokens), self.families[k]
        shares = {}
        for f, g in self.templates:
            shares[f] = max(shares.get(f, 0.0), self.share(own, g))
        confirmed = shares[name] >= CONFIRMED and shares[name] >= max(shares.values()) - 1e-9
        if not confirmed and max(shares.values()) == 1.0:  # a whole template is in the paragraph
            name = min(f for f, s in shares.items() if s == 1.0)
            return name, float(p[self.families.index(name)])
        if confirmed and p[k] >= min(self.least, 1 - p[0]):
            return name, float(p[k])
        return UNKNOWN, float(1 - p[0])

    def scan(self, texts: list[str | None]) -> list[tuple[int, dict[str, int], float]]:
        """Of each text: paragraphs that aren't blank, paragraphs by family found, the largest probability of one."""
        stream: list[bytes] = []
        ends, filled = [], []
        for t in texts:
            lines = (t or "").encode().replace(NEWLINE, b" ").replace(b"\n", b" \x01 ").translate(CLEAN).split() if t else []
            stream += lines
            stream.append(NEWLINE)
            ends.append(len(stream))
            filled.append(0)
        line, feature, size = self.features(stream)
        z = self.logits(line, feature, size)
        p = softmax(z / self.temperature)
        marks = np.flatnonzero(np.fromiter((w == NEWLINE for w in stream), bool, len(stream)))
        doc_of = np.searchsorted(np.array(ends), marks, side="right")
        filled = np.bincount(doc_of[np.flatnonzero(size[: len(marks)] > 0)], minlength=len(texts))
        out = [(int(n), {}, 0.0) for n in filled]
        lines = line[np.flatnonzero(np.diff(line, prepend=-1))]
        own = lambda at: stream[(marks[at - 1] + 1 if at else 0) : marks[at]]

        def add(at: int, name: str, sure: float, fewer: int = 0) -> None:
            n, found, most = out[doc_of[at]]
            found[name] = found.get(name, 0) + 1
            out[doc_of[at]] = (n - fewer, found, max(most, sure))

        taken = set()
        for first, last in self.blocks(stream, np.searchsorted(marks, np.array(ends) - 1)) if len(marks) else ():
            for i, j in runs([own(at) for at in range(first, last + 1)], self.templates):
                tokens = [w for at in range(first + i, first + j) for w in own(at)]
                _, feature, n = self.features(tokens)
                q = softmax(self.logits(np.zeros(len(feature), np.int64), feature, n) / self.temperature)[0]
                name, sure = self.verdict(tokens, q)
                if name != UNKNOWN:
                    taken.update(range(first + i, first + j))
                    add(first + i, name, sure, j - i - 1)
        for k in np.flatnonzero(p[:, 0] < 0.5):
            if (at := int(lines[k])) not in taken:
                add(at, *self.verdict(own(at), p[k]))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 300, sample_lines: int = 4000, sample_chars: int = 40_000) -> DataFrame:
    """Per row: id, n_paragraphs, licences (families found, sorted, comma-joined; `unknown` among them), n_licence
    (paragraphs that are licences), probability (the largest of a found family; 0 if none).

    A notice that is wrapped over several lines is one paragraph. Null, empty and blank texts have 0 paragraphs and no
    licence. Every paragraph of every text is scored; the paragraphs that teach `none` are those in the first
    sample_chars characters of the sample_docs distinct texts with the smallest hashes, at most sample_lines. Rows are
    independent, equal texts get equal results, an empty table gives an empty one, other columns are not read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).where(F.length(text_col) > 0).select(F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"), "text")
    distinct = texts.agg(F.approx_count_distinct("h")).first()[0]
    near = texts.where(F.col("h") <= int(min(1.0, 1.5 * sample_docs / max(distinct, 1)) * (1 << 30))).select("h", F.substring("text", 1, sample_chars).alias("text"))
    sample = near.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(sample_docs).collect()
    templates = template_sets()
    # The sample's order mustn't depend on the partitions.
    lines = sorted({x for r in sample for x in plain_lines(r["text"], templates)}, key=lambda x: (hash_text(x), x))[:sample_lines]
    held = docs.sparkSession.sparkContext.broadcast(Scanner(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128, 1 << 20):
            if not batch.num_rows:
                continue
            found = held.value.scan(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([",".join(sorted(x[1])) for x in found], pa.string()), pa.array([sum(x[1].values()) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], [id_col, "n_paragraphs", "licences", "n_licence", "probability"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_paragraphs bigint, licences string, n_licence bigint, probability double")


def hash_text(x: str) -> int:
    return zlib.crc32(x.encode())
