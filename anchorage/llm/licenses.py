"""Licence scans: a trained paragraph classifier with template comparison.

Paragraphs are a text's lines, and, as notices are often wrapped, all lines between two blank ones
together where no line alone is confirmed. Sparse word n-grams (one to three words) feed a softmax
regression over licence families and an unknown class, trained here on notices made from the
templates below and on ordinary prose; its temperature is calibrated on held-out notices. A
predicted family is confirmed where the paragraph shares enough word pairs with one of the
family's templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import documents, without

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Least calibrated probability of a family, and least share of the template's or paragraph's word pairs.
PROBABLE, CONFIRMED = 0.6, 0.5
NOTICES_EACH = 120
#: Word pairs in common that confirm a part of a notice.
ENOUGH = 8

#: Short notices of each family (fixed values).
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is available under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This software is distributed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "This code is covered by the BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential."],
}
#: Ordinary sentences, some about licences in passing, for the unknown class (fixed values).
ORDINARY = [
    "The driver showed a license at the border and was let through.", "A permission to build was granted by the town after a year.", "The rights of workers were discussed in public.",
    "All of the people were in the house when it was sold.", "The general said that the free press was under attack.", "This version of the story is the one that most people know.",
    "She reserved a table for two and paid by card.", "The commons were enclosed in the eighteenth century.", "He works under the bridge and sells software at night.",
    "Use the source in the garden, with or without a filter.", "The foundation published a report on public health in 2004.", "Creative work needs time, attribution and some luck.",
    "The library opens at nine and closes at five.", "Copying the picture took the whole day.", "Terms and conditions of the lease were not met.", "Dogs must have a licence in this country, version or not.",
    "Example of a file name in the manual.", "The program of the evening was printed in two forms.", "Warranty claims go to the shop.", "In 2.0 seconds the car reached the line.",
]


def words(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(ws: list[str]) -> set[str]:
    """Distinct n-grams of one to three words."""
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


@dataclass
class Scanner:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features + 1, families + 1): the last row is the bias, the last class unknown
    temperature: float
    single: frozenset[str]

    def probabilities(self, rows: list[set[str]]) -> np.ndarray:
        z = np.array([self.weights[[*(self.vocabulary[g] for g in r if g in self.vocabulary), -1]].sum(axis=0) for r in rows]).reshape(len(rows), -1)
        e = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=1, keepdims=True)

    def classify(self, paragraph: str) -> tuple[str, float, bool] | None:
        """Family, probability, and whether a template confirms it; None if unknown."""
        ws = words(paragraph)
        if self.single.isdisjoint(ws):  # no word of any licence cue: the bias alone, which is unknown
            return None
        p = self.probabilities([grams(ws)])[0]
        k = int(p.argmax())
        if k == len(self.families) or p[k] < PROBABLE:
            return None
        return self.families[k], float(p[k]), similarity(ws, self.families[k]) >= CONFIRMED


def _pairs(ws: list[str]) -> set[tuple[str, str]]:
    padded = ["", *ws, ""]
    return set(zip(padded, padded[1:], strict=False))


_TEMPLATE_PAIRS = {f: [_pairs(words(t)) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(ws: list[str], family: str) -> float:
    """Best share of word pairs that a template has in common with the paragraph: by the template's,
    or, with ENOUGH of them, by the paragraph's, as a part of a notice is one too."""
    own = _pairs(ws)
    shared = [(len(own & t), len(t)) for t in _TEMPLATE_PAIRS[family]]
    return max(max(k / n, k / len(own) if k >= ENOUGH else 0.0) for k, n in shared)


def _notices(rng: np.random.Generator, family: str, n: int) -> list[list[str]]:
    """Templates with words dropped at the ends or changed, and prose around them."""
    prose = words(" ".join(ORDINARY))
    out = []
    for _ in range(n):
        ws = words(str(rng.choice(TEMPLATES[family])))
        if len(ws) > 6 and rng.random() < 0.3:
            ws = ws[: int(rng.integers(6, len(ws) + 1))]
        for side in (0, 1):
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(prose) - 8))
                more = prose[at : at + int(rng.integers(1, 8))]
                ws = more + ws if side else ws + more
        out.append(ws)
    return out


def _prose(rng: np.random.Generator, n: int) -> list[list[str]]:
    prose = words(" ".join(ORDINARY))
    out = [words(s) for s in ORDINARY]
    cues = [w for ts in TEMPLATES.values() for t in ts for w in words(t)]
    while len(out) < n:
        at = int(rng.integers(0, len(prose) - 20))
        ws = prose[at : at + int(rng.integers(3, 20))]
        for _ in range(int(rng.integers(0, 3))):  # stray words of notices, without their company
            ws.insert(int(rng.integers(0, len(ws) + 1)), str(rng.choice(cues)))
        out.append(ws)
    return out


def train(seed: int = 7) -> Scanner:
    """Fits on made notices (a fixed number a class) and calibrates on others; some seconds."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    sets = []
    for _ in range(2):
        rows, ys = [], []
        for k, f in enumerate(families):
            made = _notices(rng, f, NOTICES_EACH)
            rows += made
            ys += [k] * len(made)
        made = _prose(rng, 6 * NOTICES_EACH)
        sets.append(([grams(r) for r in rows + made], np.array(ys + [len(families)] * len(made))))
    known = grams([]).union(*[grams(words(t)) for ts in TEMPLATES.values() for t in ts])
    vocabulary = {g: i for i, g in enumerate(sorted(known))}
    (rows, y), (held, yh) = sets

    def matrix(rs: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rs), len(vocabulary) + 1), np.float32)
        for i, r in enumerate(rs):
            x[i, [vocabulary[g] for g in r if g in vocabulary]] = 1
        x[:, -1] = 1
        return x

    x, w = matrix(rows), np.zeros((len(vocabulary) + 1, len(families) + 1), np.float32)
    target = np.eye(len(families) + 1, dtype=np.float32)[y]
    speed = np.zeros_like(w)
    for _ in range(250):
        z = x @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (e / e.sum(axis=1, keepdims=True) - target) / len(x) + 1e-4 * w
        speed = 0.9 * speed - 0.5 * g
        w = w + speed
    z = matrix(held) @ w

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), yh]))

    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss)
    common = set(words(" ".join(ORDINARY)))
    cues = frozenset(g for g in known if " " not in g and g not in common) | {"license", "licensed", "copyright", "rights", "public", "reserved", "permitted", "commons"}
    return Scanner(families, vocabulary, w, temperature, frozenset(cues))


def wrapped(model: Scanner, lines: list[str], found: list[dict]) -> list[dict]:
    """The findings, where the lines of a block are confirmed together instead of line by line."""
    out = []
    for first, last in blocks(lines, [f["line"] for f in found]):
        inside = [f for f in found if first <= f["line"] < last]
        whole = None if any(f["confirmed"] for f in inside) or last - first == 1 else model.classify(" ".join(lines[first:last]))
        out += [{"line": first, "family": whole[0], "probability": whole[1], "confirmed": True}] if whole and whole[2] else inside
    return out


def blocks(lines: list[str], hits: list[int]) -> list[tuple[int, int]]:
    """First line and end of the blocks, between blank lines, that hold hits."""
    out: list[tuple[int, int]] = []
    for k in hits:
        if out and k < out[-1][1]:
            continue
        first = last = k
        while first and lines[first - 1].strip():
            first -= 1
        while last < len(lines) and lines[last].strip():
            last += 1
        out.append((first, last))
    return out


def scanned(df: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """df with ``licenses``: a struct (line, family, probability, confirmed) a licence paragraph.

    A wrapped notice has the line that its block begins at. Whole texts, also very long ones; null
    and empty texts have none. Repeated rows get equal results, an empty table gives no rows, and
    a column of df named ``licenses`` gives way to the result. The scanner is a few hundred kB and
    is broadcast.
    """
    df = without(df, "licenses")
    shared = df.sparkSession.sparkContext.broadcast(scanner or train())
    at, names = df.columns.index(text), [*df.columns, "licenses"]
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        cue = re.compile("|".join(sorted(map(re.escape, model.single))))
        for b in batches:
            out = []
            for t in b.column(at):
                found = []
                x = t.as_py() or ""
                lines = x.split("\n")
                low = x.lower().split("\n")
                if len(low) != len(lines):
                    low = [line.lower() for line in lines]
                for k, line in enumerate(low):
                    if line not in known:
                        if len(known) > 1 << 16:
                            known.clear()
                        known[line] = model.classify(line) if cue.search(line) else None
                    if known[line]:
                        family, p, sure = known[line]
                        found.append({"line": k, "family": family, "probability": p, "confirmed": sure})
                if found and not all(f["confirmed"] for f in found):
                    found = wrapped(model, low, found)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, licenses array<struct<line:int,family:string,probability:double,confirmed:boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its confirmed families and all licence paragraphs."""
    rows = scanned(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.selectExpr(
        "doc_id",
        "array_sort(array_distinct(transform(filter(licenses, x -> x.confirmed), x -> x.family))) AS families",
        "size(licenses) AS paragraphs",
        "licenses",
    )
