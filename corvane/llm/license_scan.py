"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over hashed word one- to three-grams tells a paragraph's licence family, with a class of
its own for everything else. It is trained on the templates below, whole and in random cuts with words dropped, against
paragraphs of the corpus (a bounded sample) and made-up near misses; its temperature is set so that confidence matches
accuracy on held-out cuts. A family stands only if the text also shares enough of a template's wording. Judged are whole lines and,
in paragraphs (filled lines up to a blank one), the windows of a template's length that share enough pairs of words with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.words import BYTE, LOWER, U, Words, mix, run_hash, slabs

BITS = 16
ORDERS = 3
UNKNOWN = "unknown"
#: Short notices in their public wording, by licence family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL version 2.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL version 3.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the terms of the GNU Lesser General Public License."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is distributed under the terms of the GNU Affero General Public License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is proprietary and confidential."],
}
#: Wording that speaks of licences without granting one of the families.
NEAR_MISSES = [
    "the driver must show a valid license to the officer",
    "a fishing license is issued for one year under local rules",
    "version 2.0 of the program was released in the spring",
    "the terms of the agreement are attached to this letter",
    "this work is distributed to all members of the group",
    "licensed under the terms agreed with the publisher of the journal",
    "public schools are licensed by the general assembly",
]
FAMILIES = [*TEMPLATES, UNKNOWN]
FOUND = "doc_id long, paragraph int, family string, confidence double, similarity double"


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each filled line, and one past the last; the line's number in its document)."""
    line = np.concatenate([[0], np.cumsum(words.data == 10)])
    doc = words.doc_of()
    at = line[words.start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return np.append(first, len(at)), at[first] - line[words.off[doc[first]]]


def blocks(number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The paragraph of each filled line: lines of one document without a blank one between."""
    new = np.ones(len(number), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1] + 1)
    return np.cumsum(new) - 1


def word_hashes(words: Words) -> np.ndarray:
    """Hashes of words without punctuation at their ends, lower-cased; numbers and hyphens within stay."""
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += (start < end - 1) & ~letter[words.data[np.minimum(start, len(words.data) - 1)]]
        end -= (end - 1 > start) & ~letter[words.data[end - 1]]
    return run_hash(BYTE[LOWER[words.data]], start, end)


def lettered(words: Words) -> np.ndarray:
    """Mask of the words with a letter or digit."""
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    seen = np.concatenate([[0], np.cumsum(letter[words.data])])
    return seen[words.end] > seen[words.start]


def features(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, input) of the one- to three-grams of every paragraph."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    rows, index = [owner], [h]
    part = h
    for k in range(1, ORDERS):
        if len(h) <= k:
            break
        part = mix(part[:-1] * U(0x9E3779B97F4A7C15) + h[k:])
        same = owner[:-k] == owner[k:]
        rows.append(owner[:-k][same])
        index.append(part[same])
    return np.concatenate(rows), (np.concatenate(index) >> U(64 - BITS)).astype(np.int64)


def of_texts(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), False)
    row, index = features(word_hashes(words), words.first)
    return [np.unique(index[row == i]) for i in range(len(texts))]


def numbers_of(text: str) -> np.ndarray:
    """The inputs of a text's words with a digit: versions, which tell families apart that share all other words."""
    some = [t for t in text.split() if any(c.isdigit() for c in t)]
    h = word_hashes(Words(pa.array([" ".join(some)], pa.large_string()), False))
    return (h >> U(64 - BITS)).astype(np.int64)


def pairs_of(text: str) -> tuple[np.ndarray, int]:
    """(mask of the inputs that are a text's pairs of words, number of its distinct words)."""
    h = word_hashes(Words(pa.array([text], pa.large_string()), False))
    mask = np.zeros(1 << BITS, bool)
    mask[pairs(h)] = True
    return mask, len(np.unique(h))


def pairs(h: np.ndarray) -> np.ndarray:
    return (mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) >> U(64 - BITS)).astype(np.int64)


class Classifier:
    def __init__(self, weights: np.ndarray, temperature: float):
        self.weights, self.temperature = weights.astype(np.float32), temperature
        self.used = (np.abs(weights).max(1) > 0.02) & (np.argmax(weights, 1) != len(FAMILIES) - 1)
        self.lengths = [len(t.split()) for family in TEMPLATES.values() for t in family]
        self.pairs = [pairs_of(t) for family in TEMPLATES.values() for t in family]
        self.templates = [(k, s, numbers_of(t)) for k, family in enumerate(TEMPLATES) for t, s in zip(TEMPLATES[family], of_texts(TEMPLATES[family]), strict=True)]

    def probabilities(self, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(row, minlength=n), 1)
        z = np.zeros((n, len(FAMILIES)))
        for f in range(len(FAMILIES)):
            z[:, f] = np.bincount(row, weights=self.weights[index, f], minlength=n)
        z /= np.sqrt(size)[:, None] * self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def similarity(self, own: np.ndarray, family: int) -> float:
        """The largest share of a template's grams of this family found in the paragraph; one whose numbers are missing has none."""
        return max([0.0, *(len(np.intersect1d(own, t)) / len(t) for k, t, numbers in self.templates if k == family and np.isin(numbers, own).all())])

    def windows(self, h: np.ndarray, paragraph: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(first word, one past the last) of the windows that may share ``least`` of a template.

        Of a template's grams at most its distinct words are single words, and there are no more triples than pairs, so
        half of the rest must be pairs. In each stretch of a template's length the window with most of them is taken.
        """
        found = []
        if len(h) < 2:
            return found
        pair = pairs(h)
        any_pair = np.zeros(1 << BITS, bool)
        for mask, _ in self.pairs:
            any_pair |= mask
        spot = np.flatnonzero(any_pair[pair] & (paragraph[:-1] == paragraph[1:]))
        pair, own = pair[spot], paragraph[spot]
        last = np.searchsorted(paragraph, paragraph[spot], "right")
        for (mask, single), n, (_, grams, _) in zip(self.pairs, self.lengths, self.templates, strict=True):
            hit = np.flatnonzero(mask[pair])
            at = spot[hit]
            size = np.searchsorted(at, np.minimum(at + n - 1, last[hit] - 1)) - np.arange(len(at))
            good = np.flatnonzero(size >= max(1, int(np.ceil((least * len(grams) - single) / 2))))
            order = good[np.lexsort((at[good], -size[good], at[good] // n, own[hit][good]))]
            key = np.stack([own[hit][order], at[order] // n], 1)
            first = np.ones(len(order), bool)
            first[1:] = (key[1:] != key[:-1]).any(1)
            found += [(int(at[i]), int(min(at[i] + n, last[hit[i]]))) for i in order[first]]
        return sorted(set(found))


def train(negatives: list[str], seed: int = 5, epochs: int = 60, rate: float = 0.5) -> Classifier:
    rng = np.random.default_rng(seed)
    texts, label = [], []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            w = t.split()
            for _ in range(24):
                cut = w if len(w) <= 9 else w[rng.integers(0, len(w) // 4) : len(w) - rng.integers(0, len(w) // 4)]
                texts.append(" ".join(x for x in cut if len(cut) <= 9 or rng.random() > 0.04))
                label.append(k)
    for t in NEAR_MISSES * 24 + negatives:
        texts.append(t)
        label.append(len(FAMILIES) - 1)
    rows, y = of_texts(texts), np.array(label)
    held = rng.random(len(y)) < 0.2
    w = np.zeros((1 << BITS, len(FAMILIES)))
    speed = np.full(w.shape, 1e-6)
    model = Classifier.__new__(Classifier)
    model.weights, model.temperature = w, 1.0
    weight = np.where(y == len(FAMILIES) - 1, 1.0, 0.5)
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~held))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            row = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            index = np.concatenate([rows[i] for i in own])
            p = model.probabilities(row, index, len(own))
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[own][:, None] / np.sqrt(np.maximum(np.bincount(row, minlength=len(own)), 1))[:, None]
            used, back = np.unique(index, return_inverse=True)
            g = np.stack([np.bincount(back, weights=p[row, f], minlength=len(used)) for f in range(len(FAMILIES))], 1) / len(own)
            speed[used] += g * g
            w[used] -= rate * 0.1 * g / np.sqrt(speed[used])
        w *= 0.999
    row = np.repeat(np.arange(held.sum()), [len(rows[i]) for i in np.flatnonzero(held)])
    index = np.concatenate([rows[i] for i in np.flatnonzero(held)])
    best, temperature = np.inf, 1.0
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4):
        model.temperature = t
        loss = -np.log(model.probabilities(row, index, int(held.sum()))[np.arange(held.sum()), y[held]] + 1e-9).mean()
        if loss < best:
            best, temperature = loss, t
    return Classifier(w, temperature)


def scanning(model: Classifier, least_confidence: float, least_similarity: float):
    def run(batches):
        for batch in batches:
            out = []
            for at, _, words in slabs(batch, "text", False):
                if not len(words.start):
                    continue
                edges, number = paragraphs(words)
                lines, doc = np.diff(edges), words.doc_of()
                paragraph = np.repeat(blocks(number, doc[edges[:-1]]), lines)
                line = np.repeat(np.arange(len(lines)), lines)
                h = word_hashes(words)
                row, index = features(h, edges)
                n = len(edges) - 1
                whole = np.flatnonzero(np.bincount(row[model.used[index]], minlength=n) >= 2)
                # comment marks at the starts of lines are no words of a notice
                word = np.flatnonzero(lettered(words))
                spans = [(int(edges[j]), int(edges[j + 1]), np.arange(edges[j], edges[j + 1])) for j in whole]
                spans += [(int(word[a]), int(word[b - 1]) + 1, word[a:b]) for a, b in model.windows(h[word], paragraph[word], least_similarity)]
                if not spans:
                    continue
                edge = np.concatenate([[0], np.cumsum([len(x) for _, _, x in spans])])
                row, index = features(h[np.concatenate([x for _, _, x in spans])], edge)
                p = model.probabilities(row, index, len(spans))
                best = p.argmax(1)
                order = np.argsort(row, kind="stable")
                row, index = row[order], index[order]
                edge = np.searchsorted(row, np.arange(len(spans) + 1))
                held = []
                for j in np.flatnonzero((best < len(FAMILIES) - 1) & (p.max(1) >= least_confidence)):
                    similar = model.similarity(np.unique(index[edge[j] : edge[j + 1]]), int(best[j]))
                    if similar >= least_similarity:
                        held.append((-similar, spans[j][1] - spans[j][0], -float(p[j, best[j]]), spans[j][0], spans[j][1], FAMILIES[best[j]]))
                taken = np.zeros(len(h), bool)
                notices = []
                for similar, _, sure, a, b, family in sorted(held):
                    if not taken[a:b].any():
                        taken[a:b] = True
                        notices.append((a, family, -sure, -similar))
                for a, family, sure, similar in sorted(notices):
                    out.append((batch.column(0)[at + int(doc[a])].as_py(), int(number[line[a]]), family, sure, similar))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc_id", "paragraph", "family", "confidence", "similarity"])

    return run


def far_from_templates(lines: list[str], most: float = 0.3) -> list[str]:
    """Lines that share little with any template: not notices, although they may speak of licences."""
    templates = [s for family in TEMPLATES.values() for s in of_texts(family)]
    return [line for line, own in zip(lines, of_texts(lines), strict=True) if max(len(np.intersect1d(own, t)) / len(t) for t in templates) < most]


def fit_licenses(docs: DataFrame, most: int = 2000, words: int = 60) -> Classifier:
    """The classifier, with at most ``2 * most`` stretches of lines of at most ``most`` documents as further negatives.

    Documents and stretches are those with the least hash. Lines are cut into stretches of ``words`` words, so long ones train
    too; those that share much with a template don't, for they may be notices. The bounds keep training a matter of seconds.
    """
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lines = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    parts = lines.select(F.filter(F.split("line", "\\s+"), lambda w: F.length(w) > 0).alias("w")).where(F.size("w") > 0)
    parts = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(words)), lambda i: F.array_join(F.slice("w", i, words), " "))).alias("line")).distinct()
    return train(far_from_templates([r["line"] for r in parts.orderBy(F.xxhash64("line"), "line").limit(2 * most).collect()]))


def license_scan(docs: DataFrame, model: Classifier, least_confidence: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """doc_id, paragraph (number from 0 of the line it begins in), family, confidence, similarity of every licence notice in ``docs`` (doc_id, text).

    Null and empty texts have none; repeated rows give their notices each; paragraphs of any length are read whole; an empty
    table gives an empty result; further columns are ignored. One pass without a shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(scanning(model, least_confidence, least_similarity), FOUND)
