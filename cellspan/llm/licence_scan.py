"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates.

Training (driver, once): multinomial logistic regression with an L1 penalty over word 1- and 2-grams, on the licence
statements below, sentences that use their words in another sense, and a bounded, seeded sample of the corpus's own
paragraphs (one whole line, at a seeded place, of `sample_docs` documents at most) as the class "none". Sampled lines that
a template confirms are licences and not "none", so they are left out. Only n-grams of the statements are features.
Calibration is on wordings that training doesn't see (`HELD_OUT`) and a held-out fifth of the sample: a temperature is
fitted by likelihood. A paragraph is reported if "none" has at most `most_none`, and a family's probability below
`least_probability` is "unknown".

Every paragraph is scored that may have an n-gram with a non-zero weight: cues are the first words of those n-grams.
Without any, the biases alone decide; training makes sure that they decide for the class "none", so nothing is lost.

Scanning is DataFrame code in one pass without a shuffle. Paragraphs are the lines of a text. What is predicted as a
family is compared with the family's templates: the share of a template's words that the paragraph has, where a word
weighs the more the fewer families have it. Below
`least_overlap` the family is not confirmed and the result is "unknown".

Cases: null or empty texts have no paragraphs. Repeated paragraphs and rows are reported each. Ties go to the first
class in order. An empty table gives an empty result. Only the id and the result's columns are returned.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import documents, lower_ascii

#: Licence statements by family.
STATEMENTS = {
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL version 3.",
        "you can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public_domain": ["This work is in the public domain.", "Released into the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
    "unknown": [
        "All rights reserved.",
        "Licensed under the terms of the accompanying agreement.",
        "This work is licensed under a proprietary license.",
        "Use of this text is subject to the license agreement.",
        "Copyright by the authors. Redistribution without permission is prohibited.",
        "Available under the Artistic License 2.0.",
        "Available under OFL 1.1.",
        "Code available under CDDL 1.1.",
        "Made available under EPL 2.0.",
        "Licensed under the Academic Free License 3.0.",
        "Licensed under the Common Development Public License 1.0.",
    ],
}
#: Sentences that use the statements' words in another sense.
OTHER_SENSE = [
    "The public was let in by the east door.", "This domain of science is old.", "He has all his rights.", "Seats are reserved for guests.",
    "A new version was released in May.", "The tent is available under the tree.", "The general public may visit the village.", "They work in the public interest.",
    "She holds a driving license.", "The apache people live in the south.", "Terms of the lease are subject to change.", "The library lent a copy of this work to any person.",
    "Permission to enter was granted by the general.", "Creative work is its own reward.", "The gnu is an animal of the plains.", "The source of the river is free of charge to visit.",
]
#: Wordings by class for calibration alone.
HELD_OUT = {
    "mit": ["MIT License.", "The code is released under the MIT license."], "apache": ["Apache License 2.0 applies.", "Available under the Apache License."],
    "gpl": ["Distributed under the GNU General Public License version 3.", "GNU GPL version 3."], "lgpl": ["Distributed under the GNU Lesser General Public License."],
    "bsd": ["Distributed under the BSD 3-Clause License."], "mpl": ["Distributed under the Mozilla Public License 2.0."], "cc_by": ["Text is available under CC BY 4.0."],
    "cc_by_sa": ["Text is available under CC BY-SA 4.0."], "cc_by_nc": ["Text is available under CC BY-NC 4.0."], "public_domain": ["Dedicated to the public domain."],
    "unknown": ["Licensed under a commercial license.", "Available under the Zope Public License."],
    "none": ["The copy of the work is in the library.", "A public license office opens in May."],
}
CLASSES = ["none", *STATEMENTS]


def tokens(text: str) -> list[str]:
    """Words, ASCII lower-cased, in American spelling."""
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).replace("licenc", "licens")) if w]


def word_weights() -> dict[str, float]:
    """Words of the statements, by the logarithm of the families over those that have the word (0.05 at least)."""
    by = [{w for s in v for w in tokens(s)} for v in STATEMENTS.values()]
    return {w: max(0.05, float(np.log(len(by) / sum(w in f for f in by)))) for w in sorted(set().union(*by))}


def confirmed_by(words: list[str], least: float) -> bool:
    """Whether some template has at least that share of its weight in words."""
    weight, has = word_weights(), set(words)
    return any(sum(weight[w] for w in set(tokens(s)) & has) >= least * sum(weight[w] for w in set(tokens(s))) for v in STATEMENTS.values() for s in v)


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


@dataclass
class Model:
    """Weights (features x classes), biases, temperature and the gate's cues."""

    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    cues: list[str]


def train(negatives: list[str], seed: int = 3, penalty: float = 2e-4, steps: int = 600, drop: float = 0.15, copies: int = 6) -> Model:
    """Fit on the statements, reworded copies of them, and negatives."""
    rng = np.random.default_rng(seed)
    features = sorted({g for v in STATEMENTS.values() for s in v for g in grams(tokens(s))})
    at = {f: i for i, f in enumerate(features)}

    def rows(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(features)))
        for r, w in enumerate(texts):
            x[r, [at[g] for g in grams(w) if g in at]] = 1
        return x

    def reworded(words: list[str]) -> list[str]:
        return [w for w in words if rng.random() > drop] or words

    texts, y = [], []
    for c, name in enumerate(CLASSES[1:], 1):
        for s in STATEMENTS[name]:
            w = tokens(s)
            texts += [w] * 3 + [reworded(w) for _ in range(copies)]
            y += [c] * (3 + copies)
    for k, s in enumerate([*negatives, *OTHER_SENSE * max(1, len(negatives) // 50)]):
        if k % 5 or k >= len(negatives):
            texts.append(tokens(s)), y.append(0)
    held = [tokens(s) for v in HELD_OUT.values() for s in v]
    held_y = [CLASSES.index(c) for c, v in HELD_OUT.items() for _ in v]
    for s in negatives[::5][: len(held)]:
        held.append(tokens(s)), held_y.append(0)
    x, y = rows(texts), np.array(y)
    w, b = np.zeros((len(features), len(CLASSES))), np.zeros(len(CLASSES))
    weight = 1.0 / np.bincount(y, minlength=len(CLASSES))[y].clip(1)
    weight *= np.where(y == 0, 6.0, 1.0)
    weight /= weight.sum()
    hot, rate = np.eye(len(CLASSES))[y], 2.0
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) * weight[:, None]
        w -= rate * (x.T @ g)
        b -= rate * g.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
    b[0] = max(b[0], b.max() + 1e-6)  # a paragraph without a feature is of the class "none"
    z, hy = rows(held) @ w + b, np.array(held_y)

    def loss(t: float) -> float:
        q = z / t
        m = q.max(axis=1, keepdims=True)
        return float(-(q - m - np.log(np.exp(q - m).sum(axis=1, keepdims=True)))[np.arange(len(hy)), hy].mean())

    best = min((0.25 * k for k in range(1, 13)), key=loss)
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    cues = sorted({features[i].split(" ")[0] for i in used})
    return Model([features[i] for i in used], w[used], b, best, cues)


def sample_paragraphs(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, seed: int) -> list[str]:
    """A line each of sample_docs documents at most; those that a template confirms are left out."""
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    place = F.xxhash64(F.lit(seed), F.col("t"))
    rows = (
        docs.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
        .select(F.col(text_col).alias("t"))
        .select(F.get(F.split("t", "\n"), F.pmod(place, F.size(F.split("t", "\n"))).cast("int")).alias("p"))
        .where("trim(p) <> ''")
        .orderBy(F.xxhash64("p"), "p")
        .limit(sample_docs)
    )
    return [r[0] for r in rows.collect() if not confirmed_by(tokens(r[0]), 0.6)]


def _constant(value: object, kind: str) -> Column:
    """A literal of nested values; as one folded expression it keeps plans small."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_probability: float = 0.5, least_overlap: float = 0.6, most_none: float = 0.1,
) -> DataFrame:
    """id, paragraph (0-based line), family, probability and overlap of each licence paragraph."""
    plain = lambda c: F.replace(lower_ascii(c), F.lit("licenc"), F.lit("licens"))
    cues = _constant(model.cues, "array<string>")
    # generators keep what they make, so that no later expression evaluates it again
    kept = lambda c, name: F.explode(F.array(c)).alias(name)
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(plain(F.col(text_col)), "\n")).alias("paragraph", "p"))
    words = lines.select("id", "paragraph", kept(F.array_remove(F.split("p", "[^a-z0-9]+"), ""), "w")).where(F.arrays_overlap("w", cues))
    pairs = F.expr("CASE WHEN size(w) > 1 THEN transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) ELSE array() END")
    known = words.select("id", "paragraph", "w", kept(F.array_intersect(F.concat("w", pairs), _constant(model.features, "array<string>")), "k")).where(F.size("k") > 0)
    start = F.array(*[F.lit(float(v)) for v in model.bias])
    table = _constant(dict(zip(model.features, model.weights.tolist(), strict=True)), "map<string, array<double>>")
    z = F.aggregate("k", start, lambda acc, f: F.zip_with(acc, F.try_element_at(table, f), lambda a, b: a + b))
    scored = known.select("id", "paragraph", "w", kept(z, "z")).withColumn("top", F.array_max("z")).withColumn("best", (F.array_position("z", F.col("top")) - 1).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.col("top")) / F.lit(model.temperature)))
    scored = scored.where("best > 0").withColumns({"probability": 1 / total, "none": F.exp((F.col("z")[0] - F.col("top")) / F.lit(model.temperature)) / total})
    scored = scored.where(F.col("none") <= most_none)
    weight = word_weights()
    templates = []
    for c, name in enumerate(CLASSES[1:], 1):
        words = [sorted(set(tokens(t))) for t in STATEMENTS[name]]
        templates += [{"c": c, "whole": sum(weight[x] for x in t), "words": t} for t in words]
    book, weights = _constant(templates, "array<struct<c: int, whole: double, words: array<string>>>"), _constant(weight, "map<string, double>")
    shared = lambda t: F.aggregate(F.array_intersect("w", t["words"]), F.lit(0.0), lambda a, x: a + F.try_element_at(weights, x)) / t["whole"]
    overlap = F.array_max(F.transform(F.filter(book, lambda t: t["c"] == F.col("best")), shared))
    family = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("best") + 1)
    out = scored.withColumn("overlap", F.round(overlap, 6))
    sure = (F.col("probability") >= least_probability) & (F.col("overlap") >= least_overlap)
    return out.select(
        F.col("id").alias(id_col), "paragraph", F.when(sure, family).otherwise(F.lit("unknown")).alias("family"), F.round("probability", 6).alias("probability"), "overlap"
    )


def learned_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500, seed: int = 3) -> Model:
    return train(sample_paragraphs(docs, id_col, text_col, sample_docs, seed), seed)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, learned_from(docs))
