"""Licence paragraphs: a template comparison finds notices, a trained classifier names the family.

A paragraph is a run of lines with words; lines without (comment marks are none) stand between paragraphs. A notice is
a run of words of a paragraph, across line ends too, that holds at least ``CONFIRM`` of the word triples of a template
in their order, within ``SPREAD`` times the template's words. Runs that overlap are one notice.
The classifier is a multinomial logistic regression on hashed words and word pairs of a notice. It is trained on varied copies of the templates below (words dropped, cut short, framed by other words) and, as the unknown
class, on paragraphs of the corpus: a hashed sample of at most ``UNKNOWN_ROWS`` rows.
Scores become probabilities by one temperature and one offset of the unknown class, both fitted on held-out rows. A
notice counts if a family has ``SURE`` probability or more and a template of that family is among those it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import hashed_sample
from metalint.llm.wordhash import _LOWER, batches_of, hash_spans, mix, text_bytes, word_spans

BUCKETS = 1 << 14
UNKNOWN_ROWS = 2000
UNKNOWN_LINES = 3
UNKNOWN_CHARS = 2000
VARIANTS = 60
SURE = 0.5
CONFIRM = 0.6
SPREAD = 2

#: Customary short notices of each licence family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License."],
    "cc_by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal.", "This work is dedicated to the public domain under the CC0 Public Domain Dedication."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
            "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True
#: Bytes between words: everything in ASCII but letters and digits.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Model:
    """Weights (classes, buckets), bias, temperature and offset of the unknown class."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    offset: float


def _windows(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of runs of size words that stay within one owner."""
    if len(words) < size:
        return words[:0], owner[:0]
    at = np.flatnonzero(owner[size - 1:] == owner[:len(owner) - size + 1])
    rolled = words[at]
    for k in range(1, size):
        rolled = rolled * _STEP + words[at + k]
    return mix(rolled), owner[at]


def _paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word hashes, the paragraph of each word, the text of each paragraph, and the number of paragraphs."""
    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    starts, ends, _ = word_spans(raw, offsets, _GAP)
    words = hash_spans(raw, starts, ends)
    line = np.cumsum(_NEWLINE[raw])
    text = np.searchsorted(offsets[1:], starts, side="right")
    line = line[starts]
    change = np.concatenate([[True], (line[1:] > line[:-1] + 1) | (text[1:] != text[:-1])]) if len(line) else np.zeros(0, bool)
    owner = np.cumsum(change) - 1
    return words, owner, text[change], int(change.sum())


def _features(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, paragraph and value of every feature; a paragraph's values sum to one."""
    pairs, pair_owner = _windows(words, owner, 2)
    key, own = np.concatenate([mix(words), pairs]), np.concatenate([owner, pair_owner])
    return (key >> np.uint64(50)).astype(np.int64), own, 1 / np.maximum(1, np.bincount(own, minlength=n))[own]


def _scores(weights: np.ndarray, bias: np.ndarray, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    bucket, own, value = _features(words, owner, n)
    return np.stack([np.bincount(own, w[bucket] * value, minlength=n) for w in weights], axis=1) + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _adjusted(z: np.ndarray, temperature: float, offset: float) -> np.ndarray:
    z = z / temperature
    z[:, UNKNOWN] += offset
    return _softmax(z)


def _noise(rng: np.random.Generator, n: int) -> list[str]:
    """Words that mean nothing, to stand around a notice."""
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n)]


def _variants(seed: int = 5) -> tuple[list[str], list[int]]:
    """Varied copies of the templates, the same in every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    texts, classes = [], []
    for c, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = template.split()
            for v in range(VARIANTS):
                kept = [w for w in words if v == 0 or rng.random() > 0.08] or words
                if v % 4 == 3 and len(kept) > 8:
                    kept = kept[:max(6, int(len(kept) * 0.8))]
                if v % 3 == 1:
                    kept = [*_noise(rng, int(rng.integers(0, 8))), *kept, *_noise(rng, int(rng.integers(0, 8)))]
                texts.append(" ".join(kept).upper() if v % 10 == 9 else " ".join(kept))
                classes.append(c)
    return texts, classes


def _fit(words: np.ndarray, owner: np.ndarray, classes: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    bucket, own, value = _features(words, owner, len(classes))
    known, column = np.unique(bucket, return_inverse=True)
    share = 1 / np.bincount(classes, minlength=UNKNOWN + 1)[classes] / (UNKNOWN + 1)
    target = np.eye(UNKNOWN + 1)[classes]
    w, bias = np.zeros((UNKNOWN + 1, len(known))), np.zeros(UNKNOWN + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.stack([np.bincount(own, x[column] * value, minlength=len(classes)) for x in w], axis=1) + bias
        slope = (_softmax(z) - target) * share[:, None]
        grad = np.stack([np.bincount(column, value * slope[own, c], minlength=len(known)) for c in range(UNKNOWN + 1)]) + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        bias -= 0.5 * slope.sum(axis=0)
    out = np.zeros((UNKNOWN + 1, BUCKETS), np.float32)
    out[:, known] = w
    return out, bias


def train(docs: DataFrame) -> Model:
    """A model from the templates and, as the unknown class, paragraphs of docs (doc_id, text).

    These are the first UNKNOWN_LINES lines of UNKNOWN_ROWS rows, so the training set has a bound that no input
    changes. Paragraphs with a notice by their word triples are left out of the unknown class.
    """
    lines = F.transform(F.slice(F.split("text", "\n"), 1, UNKNOWN_LINES), lambda x: F.substring(x, 1, UNKNOWN_CHARS))
    known = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    sample = hashed_sample(known, "doc_id", UNKNOWN_ROWS).select("doc_id", lines.alias("lines")).collect()
    texts, classes = _variants()
    unknown = [p for r in sample for p in r["lines"] if _WORD.search(p)] or ["no licence here"]
    words, owner, _, _ = _paragraphs(pa.array(unknown))
    confirmed = {int(owner[start]) for start, _, _ in notices(words, owner)}
    unknown = [u for i, u in enumerate(unknown) if i not in confirmed]
    classes = np.array([*classes, *[UNKNOWN] * len(unknown)])
    words, owner, _, n = _paragraphs(pa.array([*texts, *unknown]))
    held = np.arange(n) % 5 == 4
    rank = np.cumsum(~held) - 1
    mine = ~held[owner]
    weights, bias = _fit(words[mine], rank[owner[mine]], classes[~held])
    z = _scores(weights, bias, words, owner, n)[held]
    grid = [(t, o) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0) for o in (-4.0, -2.0, -1.0, 0.0, 1.0, 2.0, 4.0)]
    loss = [-np.log(_adjusted(z.copy(), t, o)[np.arange(len(z)), classes[held]] + 1e-12).mean() for t, o in grid]
    temperature, offset = grid[int(np.argmin(loss))]
    return Model(weights, bias, temperature, offset)


@cache
def _template_places() -> tuple[dict[int, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Templates and places in them by word triple; family and number of triples of each template."""
    places: dict[int, list[tuple[int, int]]] = {}
    templates = []
    for c, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words, owner, _, _ = _paragraphs(pa.array([template]))
            triples = _windows(words, owner, 3)[0].tolist()
            for k, triple in enumerate(triples):
                places.setdefault(triple, []).append((len(templates), k))
            templates.append((c, len(triples)))
    return places, templates


def notices(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, set[int]]]:
    """First word, end and families of each notice: overlapping runs with CONFIRM of a template's triples in order."""
    if len(words) < 3:
        return []
    places, templates = _template_places()
    rolled, of = _windows(words, owner, 3)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    hit = np.isin(rolled, np.array(list(places), np.uint64))
    # Of each template the chains of triples that may go on: paragraph, place in the template, length, first word.
    open_chains: list[list[tuple[int, int, int, int]]] = [[] for _ in templates]
    runs = []
    for here, triple, paragraph in zip(at[hit].tolist(), rolled[hit].tolist(), of[hit].tolist(), strict=True):
        for t, k in places[triple]:
            family, size = templates[t]
            earliest = here + 3 - SPREAD * (size + 2)
            chains = [x for x in open_chains[t] if x[0] == paragraph and x[3] >= earliest]
            length, first = max(((x[2] + 1, x[3]) for x in chains if x[1] < k), default=(1, here))
            open_chains[t] = [*chains, (paragraph, k, length, first)]
            if length >= CONFIRM * size:
                runs.append((first, here + 3, family))
    out: list[tuple[int, int, set[int]]] = []
    for first, end, family in sorted(runs):
        if out and first < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2] | {family})
        else:
            out.append((first, end, {family}))
    return out


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, family, families) for every row of docs (doc_id, text).

    Other columns are not looked at. A paragraph is a run of lines with words; it is licensed once for each family
    that its notices have. family is the one with most licensed paragraphs (the first by name of
    several), families all of them in order; null and empty where there is none. Nulls and texts without words have no
    paragraphs, repeated rows give repeated results, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = shared.value
        for batch in batches_of(batches, 512):
            words, owner, text, _ = _paragraphs(batch.column("text"))
            counts = np.zeros((batch.num_rows, len(FAMILIES)), np.int64)
            held = notices(words, owner)
            if held:
                inside = np.concatenate([np.arange(first, end) for first, end, _ in held])
                of = np.repeat(np.arange(len(held)), [end - first for first, end, _ in held])
                p = _adjusted(_scores(known.weights, known.bias, words[inside], of, len(held)), known.temperature, known.offset)[:, :UNKNOWN]
                best = p.argmax(axis=1)
                sure = {(int(owner[first]), int(b)) for (first, _, families), b, q in zip(held, best, p, strict=True) if q[b] >= SURE and b in families}
                for paragraph, c in sure:
                    counts[text[paragraph], c] += 1
            found = [[FAMILIES[c] for c in np.flatnonzero(row)] for row in counts]
            main = [FAMILIES[row.argmax()] if row.any() else None for row in counts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int64)), pa.array(counts.sum(axis=1)),
                pa.array(main, pa.string()), pa.array(found, pa.list_(pa.string()))],
                names=["doc_id", "n_paragraphs", "n_licensed", "family", "families"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, family string, families array<string>")
