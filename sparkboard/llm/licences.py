"""Licence scans: a paragraph classifier over word n-grams, confirmed by comparison with templates.

A multinomial logistic regression with an L1 penalty learns, from the templates' notices in varied
wordings and from paragraphs of the corpus, which n-grams point to which licence family or to none. Its
few weights become one expression. A family holds only if its probability passes a threshold calibrated on
corpus paragraphs kept apart, and if enough of the n-grams of one of its templates are in the paragraph;
a paragraph that is like a licence but like no family is `unknown`.

The scan is a projection: paragraphs are the lines of a text and the runs of lines a notice may be wrapped
over. They are looked at only if they hold one of the anchor words, which are chosen so that a text without
any has too few of every template's n-grams.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import column, smallest_hash

NONE, UNKNOWN = "none", "unknown"
TOKEN = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"

# The usual short notices of well-known licences.
NOTICES = {
    "agpl-3.0": [
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
    ],
    "bsd": [
        "licensed under the BSD 3-Clause License", "released under the BSD License", "licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0", "licensed under CC BY-NC-SA 4.0", "licensed under CC BY-NC-ND 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "dedicated to the public domain under CC0 1.0", "Creative Commons Zero v1.0 Universal", "SPDX-License-Identifier: CC0-1.0",
        "has waived all copyright and related or neighboring rights to this work",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "isc": [
        "licensed under the ISC License", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 2.1", "licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License", "licensed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": [
        "subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved", "Copyright 2020 the authors, all rights reserved", "Copyright by the publisher. All rights reserved.",
        "confidential and proprietary", "this file is proprietary and confidential",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense",
    ],
}
BEFORE = ["", "this work is", "this file is", "this project is", "the code in this repository is", "note that all content here is", "copyright 2020 the authors"]
AFTER = ["", "see the license file for details", "all rights reserved", "unless noted otherwise", "by its authors"]
#: Wordings that talk about licences and grant none.
TALK = [
    "the license of the driver was checked at the gate", "a general public meeting will be held", "please read the terms of the license",
    "the public domain is a topic of its own", "he was granted permission to use the road", "the version of the story in the file",
    "free software is a matter of liberty", "the foundation published its report", "copyright 2020 by the publisher",
    "creative people and the commons", "the commercial license can be bought from our office", "version 2.0", "see the file for details",
]


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass(frozen=True)
class Scanner:
    families: tuple[str, ...]  # the last is NONE
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    threshold: float
    similar: float
    anchors: tuple[str, ...]

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in ngrams(words) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def anchors(similar: float, background: set[str]) -> tuple[str, ...]:
    """Words without which a line has less than the share `similar` of every template's n-grams.

    Words the background does not use come first, then those which most n-grams hold.
    """
    found: set[str] = set()
    for notice in itertools.chain.from_iterable(NOTICES.values()):
        grams = ngrams(tokens(notice))
        while True:
            left = [g for g in grams if not found & set(g.split())]
            if len(left) < similar * len(grams):
                break
            words = {w for g in left for w in g.split()}
            found.add(min(words, key=lambda w: (w in background or len(w) < 3, -sum(w in g.split() for g in left), w)))
    return tuple(sorted(found))


def trained(docs: DataFrame, text_col: str = "text", rows: int = 2000, similar: float = 0.6, penalty: float = 5e-4, rounds: int = 300) -> Scanner:
    """Learn from the templates and from lines of at most `rows` texts, those with the smallest hashes.

    Half of the texts train, the other half calibrate the threshold. Lines which match a template take no
    part: they are notices.
    """
    text = column(text_col).cast("string")
    picked = smallest_hash(docs.select(text.alias("t")).where("t is not null"), ["t"], rows, docs.count())
    lines = [(w, ngrams(w)) for r in picked.collect() for line in r["t"].split("\n") if (w := tokens(line))]
    templates = [ngrams(tokens(n)) for n in itertools.chain.from_iterable(NOTICES.values())]
    lines = [(w, g) for w, g in lines if not any(len(t & g) >= similar * len(t) for t in templates)]
    families = (*NOTICES, NONE)
    positive = [
        (k, ngrams(tokens(f"{a} {notice} {b}"))) for k, f in enumerate(NOTICES) for notice in NOTICES[f] for a in BEFORE for b in AFTER
    ]
    vocabulary = sorted(set().union(*templates))
    place = {g: i for i, g in enumerate(vocabulary)}
    examples: dict[tuple[int, frozenset[str]], int] = {}
    none = len(families) - 1
    for k, grams in [*positive, *((none, g) for _, g in lines[::2]), *((none, ngrams(tokens(f"{a} {t}"))) for t in TALK for a in BEFORE)]:
        key = k, frozenset(grams & place.keys())
        examples[key] = examples.get(key, 0) + 1
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    y = np.zeros((len(examples), len(families)), np.float32)
    n = np.sqrt(np.array(list(examples.values()), np.float32))
    for i, (k, grams) in enumerate(examples):
        x[i, [place[g] for g in grams]] = 1
        y[i, k] = 1
    n /= n.sum()
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    # Of the rows' squared lengths, the bias's one included, the mean bounds the curvature.
    v, c, t, step = w, b, 1.0, 2.0 / (1 + float((n * x.sum(axis=1)).sum()))
    for _ in range(rounds):
        z = x @ v + c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        wrong = (e / e.sum(axis=1, keepdims=True) - y) * n[:, None]
        new = v - step * (x.T @ wrong)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * wrong.sum(axis=0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (before - 1) / t * (new - w), bias + (before - 1) / t * (bias - b)
        w, b = new, bias
    weights = {g: tuple(map(float, w[i])) for g, i in place.items() if np.any(w[i])}
    draft = Scanner(families, weights, tuple(map(float, b)), 0.5, similar, anchors(similar, {w for words, _ in lines for w in words}))
    held_out = max((float(draft.probabilities(words)[:-1].max()) for words, g in lines[1::2] if g & weights.keys()), default=0.5)
    return Scanner(families, weights, draft.bias, min(0.9, max(0.4, held_out)), similar, draft.anchors)


#: The words of the longest template: a notice that starts and ends amid lines holds fewer in the lines between.
LONGEST = max(len(tokens(n)) for n in itertools.chain.from_iterable(NOTICES.values()))


def _windows(anchor: str) -> Column:
    """The runs of lines a notice may be wrapped over: (line, last_line, notice), each with an anchor word.

    No line of a run is blank; comment signs alone are blank. From each line on, runs go on as long as the lines
    between the first and the last hold fewer words than the longest template.
    """
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.struct(x.alias("x"), F.size(F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), F.lit(1))).alias("n"), x.rlike(anchor).alias("a")))

    def ends(near: Column) -> Column:
        """How many of the lines, the first one included, a run may have."""
        start = F.struct(F.when(F.get(near, F.lit(0))["n"] > 0, 1).otherwise(0).alias("size"), F.lit(0).alias("between"), (F.get(near, F.lit(0))["n"] > 0).alias("on"))
        more = lambda a, x: a["on"] & (x["n"] > 0) & (a["between"] < LONGEST)
        return F.aggregate(
            F.slice(near, 2, LONGEST + 1), start,
            lambda a, x: F.struct(
                F.when(more(a, x), a["size"] + 1).otherwise(a["size"]).alias("size"),
                F.when(more(a, x), a["between"] + x["n"]).otherwise(a["between"]).alias("between"), more(a, x).alias("on"),
            ),
        )["size"]

    def starting(all_lines: Column, i: Column) -> Column:
        def sized(near: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(1), F.greatest(ends(near), F.lit(1))), lambda m: F.struct(
                i.alias("line"), (i + m - 1).alias("last_line"), F.slice(near, F.lit(1), m).alias("of")))
            kept = F.filter(runs, lambda r: (F.get(near, F.lit(0))["n"] > 0) & F.exists(r["of"], lambda x: x["a"]))
            return F.transform(kept, lambda r: F.struct(r["line"], r["last_line"], F.array_join(F.transform(r["of"], lambda x: x["x"]), "\n").alias("notice")))

        return _once(F.slice(all_lines, i + 1, F.lit(LONGEST + 2)), lambda near: F.when(F.exists(near, lambda x: x["a"]), sized(near)))

    found = _once(lines, lambda every: F.transform(F.sequence(F.lit(0), F.size(every) - 1), lambda i: starting(every, i)))
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def scanned(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, last_line, family, probability, similarity, notice): a row per licence notice.

    A notice is a line, or a run of lines it is wrapped over; lines count from 0, blank ones too. Of
    overlapping runs the one with a family, most like its template, then the shortest and first counts. Null
    and empty texts have no rows; repeated rows each give theirs.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("t"))
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, scanner.anchors)) + r")(?![a-z0-9])"
    rows = rows.where(F.col("t").rlike(anchor))
    # The weights of the few n-grams that have any, and the templates, are constants of the plan.
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    known, bias = constant(scanner.weights, "map<string,array<double>>"), constant(scanner.bias, "array<double>")
    templates = constant([[sorted(ngrams(tokens(n))) for n in NOTICES[f]] for f in scanner.families[:-1]], "array<array<array<string>>>")

    def grams(w: Column) -> Column:
        pairs = F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.get(w, i), b))
        return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))

    def judged(g: Column) -> Column:
        hits = F.filter(F.transform(g, lambda x: F.try_element_at(known, x)), lambda h: h.isNotNull())
        z = F.aggregate(hits, bias, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))

        def best_of(p: Column) -> Column:
            best = F.array_max(F.slice(p, 1, len(scanner.families) - 1))
            k = (F.array_position(p, best) - 1).cast("int")
            share = F.transform(F.get(templates, k), lambda t: F.size(F.array_intersect(t, g)) / F.size(t))
            return F.struct(best.alias("probability"), k.alias("k"), F.array_max(share).alias("similarity"), F.element_at(p, -1).alias("none"))

        return _once(_once(_once(z, _exponents), _shares), best_of)

    def candidate(r: Column) -> Column:
        def ranked(f: Column) -> Column:
            sure = (f["probability"] >= scanner.threshold) & (f["similarity"] >= scanner.similar)
            # Sorted by these: with a family first, then the most similar, the shortest, the first.
            return F.struct(
                F.when(sure, 0).otherwise(1).alias("rank"), F.when(sure, -f["similarity"]).otherwise(0.0).alias("unlike"),
                (r["last_line"] - r["line"]).alias("more"), r["line"].alias("line"), r["last_line"].alias("last_line"),
                f["probability"].alias("probability"), f["similarity"].alias("similarity"), f["none"].alias("none"), f["k"].alias("k"), r["notice"].alias("notice"),
            )

        words = F.regexp_extract_all(F.lower(r["notice"]), F.lit(f"({TOKEN})"), F.lit(1))
        return _once(_once(_once(words, grams), judged), ranked)

    good = F.filter(F.transform(_windows(anchor), candidate), lambda c: (c["rank"] == 0) | (c["none"] < 0.5))
    # Materialised by the explode: the best runs, no two of which overlap.
    rows = rows.select("id", F.explode(F.array(F.array_sort(good))).alias("good")).where(F.size("good") > 0)
    shape = rows.schema["good"].dataType
    apart = F.aggregate(
        "good", F.array().cast(shape),
        lambda kept, c: F.when(F.exists(kept, lambda k: (k["line"] <= c["last_line"]) & (c["line"] <= k["last_line"])), kept).otherwise(F.concat(kept, F.array(c))),
    )
    rows = rows.select("id", F.explode(apart).alias("f"))
    family = F.when(F.col("f.rank") == 0, F.get(constant(scanner.families, "array<string>"), F.col("f.k"))).otherwise(UNKNOWN)
    return rows.select("id", "f.line", "f.last_line", family.alias("family"), "f.probability", "f.similarity", "f.notice")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value which is evaluated once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _exponents(z: Column) -> Column:
    return F.transform(z, lambda x: F.exp(x - F.array_max(z)))


def _shares(e: Column) -> Column:
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
