"""Operator 5: licence scans by a trained paragraph classifier. DataFrame functions only on the path of the data.

Model: multinomial logistic regression over word 1- to 3-grams, one class for each licence family and one for `unknown`. It is trained in numpy on
the driver from the families' notices below, varied by context words and dropped words, against paragraphs that only talk of licences, and
words and runs of 25 words of a bounded sample of the corpus' own texts (NEGATIVES rows, a documented parameter). Weights of small size are set to
zero, so the model is a sparse table of a few thousand n-grams; its size depends on the notices and not on the corpus. The temperature of
the softmax and the bias of `unknown` are calibrated on notices, and on paragraphs of no licence, that a first model saw no variant of.

Scan: a paragraph is a line of a document. A paragraph of which all n-grams that the model knows are common ones can't outweigh the bias of
`unknown`; anchors() derives from the weights for which n-grams that holds, and every paragraph with another of the model's n-grams is scored. A notice may be
wrapped: windows of neighbouring lines (WINDOWS), and whole runs of lines up to a blank one, are scored too if they hold one of the pairs of words
without which no template is confirmed. A line that is confirmed stands for itself and parts its neighbours as a blank one does. Windows and runs give a
row, numbered by its first line, only if they are confirmed; of overlapping ones of a family the inner and then the most similar counts. Distinct candidate paragraphs are cut into n-grams, joined
with the weights, summed by family, and turned into probabilities. A prediction other than `unknown` is confirmed if the words of one of the
family's templates are contained in the paragraph to at least CONTAINED, as pairs of words. Results are joined back to all
paragraphs that have the text, so copies are scored once.

Defined results: one row for each paragraph of a document that is predicted to be of a family; null and empty texts give none; repeated rows give
repeated rows; a null doc_id stays null; texts of any length are read whole; other columns are not read; ties go to the first family by name; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, keep, table

# Notices by which public licences are named.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3", "GNU AGPLv3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Apache 2.0 license"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "Released under the BSD 3-Clause License", "licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "licensed under CC BY 3.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0 license"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["CC0 1.0 Universal public domain dedication", "released under CC0", "dedicated to the public domain", "this is free and unencumbered software released into the public domain"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "released under the GNU GPL version 2", "SPDX-License-Identifier: GPL-3.0-only", "licensed under the GPLv3"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1", "under the terms of the GNU LGPL version 3", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved", "All rights reserved. Unauthorized copying of this file is strictly prohibited", "Confidential and proprietary. All rights reserved", "may not be reproduced without written permission of the copyright owner"],
}
#: Paragraphs that only talk of such things.
TALK = [
    "he renewed his driving license at the office last week", "the license plate of the car was found", "a licensed doctor must sign the form", "the city issued a liquor license to the bar",
    "she applied for a fishing license", "students of the MIT department gave a talk about public transport", "the Apache helicopter landed near the general", "the warranty of the phone ended in may",
    "version 2.0 of the game was released in june", "copyright law is taught in the second year", "they asked for permission to enter the public garden", "the license fee rose by two percent this year",
    "poetic license is common in such films", "the creative commons room is open to the public", "the software was released in march and has many users", "a general public meeting about the free software fair", "the agency licensed three new drugs",
    "all rights of workers were discussed", "the redistribution of land was a public matter", "permission was granted to build a house", "commercial use of the hall needs a license from the city",
]
WINDOWS = (2, 3, 4)
UNKNOWN = "unknown"
NEGATIVES = 400
CONTAINED = 0.6
MIN_PROBABILITY = 0.5

_WORD = "[^a-z0-9]+"


def grams(words: list[str]) -> list[str]:
    """Distinct 1- to 3-grams."""
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(_WORD, text.lower()) if w]


def _variants(rng: np.random.Generator, notice: list[str], filler: list[str], n: int) -> list[list[str]]:
    out = []
    for _ in range(n):
        kept = [w for w in notice if rng.random() > 0.06] or notice
        before, after = (list(rng.choice(filler, int(rng.integers(0, 9)))) for _ in range(2))
        out.append([*before, *kept, *after])
    return out


class Classifier:
    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.vocabulary, self.weights, self.bias, self.temperature = families, vocabulary, weights, bias, temperature

    def probabilities(self, words: list[str]) -> np.ndarray:
        """The model on one paragraph in Python, for tests."""
        at = {g: i for i, g in enumerate(self.vocabulary)}
        found = [at[g] for g in grams(words) if g in at]
        z = (self.bias + self.weights[found].sum(axis=0)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def train(filler: list[str], seed: int = 5, variants: int = 24, epochs: int = 200) -> Classifier:
    """filler: words of the corpus in its order, for the context of notices and for paragraphs of no licence."""
    rng = np.random.default_rng(seed)
    # the corpus' own text, but for what may be a notice
    pairs = set(rare_pairs(filler))
    runs = [filler[i : i + 25] for i in range(0, len(filler), 25)]
    runs = [r for r in runs if not pairs.intersection({*r, *(" ".join(p) for p in zip(r, r[1:], strict=False))})]
    filler = sorted(set(filler)) or ["the", "of", "and"]
    families = sorted([*TEMPLATES, UNKNOWN])
    texts, labels, held = [], [], []
    for family, notices in TEMPLATES.items():
        for k, notice in enumerate(notices):
            for v in [_words(notice), *_variants(rng, _words(notice), filler, variants)]:
                texts.append(v)
                labels.append(families.index(family))
                held.append(k > 1 and k == len(notices) - 1)  # the last notice of families with three or more
    loose = sorted({w for ts in TEMPLATES.values() for t in ts for w in _words(t)})
    for k, t in enumerate([*map(_words, TALK), *[list(rng.choice(filler, int(rng.integers(3, 30)))) for _ in range(150)], *[list(rng.choice(loose, 2)) + list(rng.choice(filler, 8)) for _ in range(250)]]):
        for v in _variants(rng, t, filler, 3):
            texts.append(v)
            labels.append(families.index(UNKNOWN))
            held.append(k % 5 == 4)
    for k, r in enumerate(runs):
        texts.append(r)
        labels.append(families.index(UNKNOWN))
        held.append(k % 5 == 4)
    known = {g for t in [*TEMPLATES.values(), TALK] for s in t for g in grams(_words(s))}
    vocabulary = sorted(known)
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    for r, t in enumerate(texts):
        x[r, [at[g] for g in grams(t) if g in at]] = 1
    y, held_out = np.array(labels), np.array(held)
    # calibrated on notices and paragraphs that a first model has not seen in any variant
    w, b = _fit(x[~held_out], y[~held_out], len(families), epochs)
    z = x[held_out] @ w + b
    best = min(((_loss(z, y[held_out], t, u, families.index(UNKNOWN)), t, u) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4) for u in (-1.0, -0.5, 0.0, 0.5, 1.0)), key=lambda v: v[0])
    w, b = _fit(x, y, len(families), epochs)
    b[families.index(UNKNOWN)] += best[2]
    used = np.abs(w).max(axis=1) > 0
    return Classifier(families, [v for v, k in zip(vocabulary, used, strict=True) if k], w[used].astype(np.float64), b.astype(np.float64), best[1])


def _fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent, classes weighing alike; small weights become zero."""
    target = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    share = np.ones(classes) * len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes)))
    rate = share[y][:, None].astype(np.float32)
    for epoch in range(epochs):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = rate * (p - target) / len(y)
        step = 4.0 / (1 + epoch / 150)
        w -= step * (x.T @ g)
        b -= step * g.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * 1e-5, 0)  # sparse weights
    return w, b


def _loss(z: np.ndarray, y: np.ndarray, temperature: float, shift: float, unknown: int) -> float:
    z = z.astype(np.float64).copy()
    z[:, unknown] += shift
    z /= temperature
    z -= z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())


def corpus_words(docs: DataFrame, n: int = NEGATIVES) -> list[str]:
    """Words of a bounded sample, for training only: 200 characters of one document, that of least hash, for each of n classes of hashes."""
    some = docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.substring("text", 1, 200).alias("t"))
    some = some.groupBy(F.pmod("h", F.lit(n)).alias("c")).agg(F.min_by("t", "h").alias("t")).toPandas().sort_values("c")
    return [w for t in some["t"] for w in _words(t)]


def anchors(model: Classifier, common: list[str]) -> list[str]:
    """N-grams of which a paragraph must hold one to be of a family; `common` is a list of words of the corpus, in its order.

    N-grams are left out, the most common first, as long as all that are left out weigh less, in sum, than the bias of `unknown` is above a family's,
    for every family. So no paragraph without an anchor is predicted to be of one, whatever it holds. Anchors that hold another are implied by it.
    """
    unknown = model.families.index(UNKNOWN)
    margin = np.delete(np.maximum(model.weights - model.weights[:, [unknown]], 0), unknown, axis=1)
    room = np.delete(model.bias[unknown] - model.bias, unknown) - 1e-6
    count = Counter(" ".join(common[i : i + n]) for n in (1, 2, 3) for i in range(len(common) - n + 1))
    total, out = np.zeros(len(room)), set()
    for i in sorted(range(len(model.vocabulary)), key=lambda i: (-count[model.vocabulary[i]], model.vocabulary[i])):
        if (total + margin[i] < room).all():
            total += margin[i]
            out.add(model.vocabulary[i])
    left = [g.split(" ") for g in model.vocabulary if g not in out]
    names = {" ".join(g) for g in left}
    parts = lambda g: {" ".join(g[i : i + n]) for n in range(1, len(g)) for i in range(len(g) - n + 1)}
    return sorted(" ".join(g) for g in left if not parts(g) & names)


def _pairs(text: str) -> list[str]:
    return sorted({" ".join(p) for p in zip(_words(text), _words(text)[1:], strict=False)} or set(_words(text)))


def rare_pairs(common: list[str], family: str | None = None) -> list[str]:
    """Pairs of words of which a text must hold one to be confirmed (as of the family): of each template as many of the rarest as may be missing, and one more."""
    count = Counter(common)
    out = set()
    for t in (t for f, ts in TEMPLATES.items() for t in ts if family in (None, f)):
        pairs = sorted(_pairs(t), key=lambda p: (min(count[w] for w in p.split(" ")), p))
        least = next(n for n in range(len(pairs) + 1) if n / len(pairs) >= CONTAINED)
        out.update(pairs[: len(pairs) - least + 1])
    return sorted(out)


def _any(phrases: list[str]) -> str:
    """A regular expression of any of the phrases in lower case as whole words, as a tree of their characters."""

    def tree(xs: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for x in xs:
            if x:
                heads.setdefault(x[0], []).append(x[1:])
        inner = [(_WORD if c == " " else c) + tree(rest) for c, rest in sorted(heads.items())]
        return "(?:" + "|".join([*inner, *[""] * ("" in xs)]) + ")" if inner else ""

    return rf"(?<![a-z0-9]){tree(sorted(set(phrases)))}(?![a-z0-9])"


def texts(docs: DataFrame, model: Classifier, common: list[str]) -> DataFrame:
    """docs(doc_id, text) -> tl_row, doc_id, text, tl_words, tl_pairs: the texts that may hold a candidate, each read once, written and read back."""
    words, pairs, low = _any(anchors(model, common)), _any(rare_pairs(common)), F.lower("text")
    docs = docs.where("text is not null").select(F.monotonically_increasing_id().alias("tl_row"), "doc_id", "text", low.rlike(words).alias("tl_words"), (F.col("text").contains("\n") & low.rlike(pairs)).alias("tl_pairs"))
    return keep(docs.where("tl_words or tl_pairs"), "licence-texts")


def single(docs: DataFrame, model: Classifier, common: list[str]) -> DataFrame:
    """texts() -> tl_row, doc_id, paragraph (from 0), lines (1), text: the candidates of one line."""
    lines = docs.where("tl_words").select("tl_row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return lines.where(F.lower("text").rlike(_any(anchors(model, common)))).select("tl_row", "doc_id", "paragraph", F.lit(1).alias("lines"), "text")


def wrapped(docs: DataFrame, done: DataFrame, common: list[str]) -> DataFrame:
    """texts(), done(tl_row, paragraph): the confirmed lines -> candidates of more lines, in the columns of single().

    A confirmed line stands for itself and parts its neighbours as a blank one does; most texts hold no rare pair beside such lines and are done.
    """
    done = done.groupBy("tl_row").agg(F.collect_set("paragraph").alias("tl_done"))
    pairs = _any(rare_pairs(common))
    docs = docs.where("tl_pairs").join(done, "tl_row", "left").withColumn("tl_done", F.coalesce("tl_done", F.array().cast("array<int>")))
    docs = docs.withColumn("tl_lines", F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("tl_done", i), "").otherwise(x)))
    docs = docs.select("tl_row", "doc_id", "tl_lines", F.array_join("tl_lines", "\n").alias("text"))
    docs = keep(docs.where(F.lower("text").rlike(pairs)), "licence-rest")
    full = lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""
    out = None
    for n in WINDOWS:
        x = docs.where(F.size("tl_lines") >= n).select("tl_row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tl_lines") - n + 1), lambda i, n=n: F.slice("tl_lines", i, n))).alias("paragraph", "some"))
        x = x.where(F.forall("some", full)).select("tl_row", "doc_id", "paragraph", F.lit(n).alias("lines"), F.array_join("some", "\n").alias("text"))
        out = x if out is None else out.unionByName(x)
    # runs, each behind the blank line before it
    runs = docs.select("tl_row", "doc_id", F.split("text", r"(?<=\n)(?=[^\S\n]*\n)").alias("runs")).select("*", F.posexplode("runs").alias("at", "text"))
    runs = runs.withColumn("blank", F.when(F.col("text").rlike(r"^[^\S\n]*\n"), 1).otherwise(0))
    runs = runs.withColumn("paragraph", F.size(F.split(F.array_join(F.slice("runs", F.lit(1), F.col("at")), ""), "\n")) - 1 + F.col("blank"))
    runs = runs.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"^[^\S\n]*\n", ""), r"\n$", ""))
    runs = runs.withColumn("lines", F.size(F.split("text", "\n"))).where(F.col("lines") > max(WINDOWS))
    return out.unionByName(runs.select("tl_row", "doc_id", "paragraph", "lines", "text")).where(F.lower("text").rlike(pairs))


def _gram_array(words: Column, most: int = 3) -> Column:
    """Distinct 1- to most-grams of an array of words, which may be any expression and is computed once."""

    def grams_of(words: Column) -> Column:
        def run(n: int) -> Column:
            return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(words, *[run(n) for n in range(2, most + 1)]))

    return F.transform(F.array(words), grams_of)[0]


def _scored(found: DataFrame, model: Classifier) -> DataFrame:
    """Candidates with family, probability, similarity and confirmed, those that are predicted to be of a family; equal texts are scored once, under their hash."""
    spark, k = found.sparkSession, len(model.families)
    found = keep(found.withColumn("tl_hash", F.sha2("text", 256)), "paragraphs")
    counted = found.groupBy("tl_hash").agg(F.count(F.lit(1)).alias("tl_n"), F.min("text").alias("text"))
    # few bytes but much work for each paragraph: as many tasks as shuffle partitions, whatever the size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = F.filter(F.split(F.lower("text"), _WORD), lambda w: w != "")
    grams_of = keep(counted.repartition(parts, "tl_hash").select("tl_hash", "tl_n", _gram_array(words).alias("grams")).select("tl_hash", "tl_n", F.array_intersect("grams", _known(model)).alias("grams")), "grams")
    # one row an n-gram: bounded by the notices above, not by the corpus
    weights = spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(model.vocabulary, model.weights, strict=True)], "gram string, weight array<double>")
    hits = grams_of.select("tl_hash", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy("tl_hash").agg(*[F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(k)])
    logits = F.array(*[(F.col(f"s{i}") + F.lit(float(model.bias[i]))) / F.lit(float(model.temperature)) for i in range(k)])
    scored = sums.select("tl_hash", logits.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("probability", 1.0 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    families = F.array(*[F.lit(f) for f in model.families])
    scored = scored.withColumn("family", F.element_at(families, F.array_position("z", F.col("top")).cast("int")))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY)).select("tl_hash", "family", "probability")
    # templates of the predicted family: the share of their pairs of words that the paragraph holds
    pairs = [(f, _pairs(t)) for f, ts in TEMPLATES.items() for t in ts]
    templates = spark.createDataFrame(pairs, "family string, pairs array<string>")
    similar = scored.join(grams_of, "tl_hash").join(F.broadcast(templates), "family").withColumn("similarity", F.size(F.array_intersect("grams", "pairs")) / F.size("pairs"))
    similar = similar.groupBy("tl_hash", "tl_n").agg(F.first("family").alias("family"), F.first("probability").alias("probability"), F.max("similarity").alias("similarity"))
    # very common paragraphs by a broadcast of a bounded number of them
    out = join_counted(found, keep(similar, "similar"), ["tl_hash"], found.count())
    return out.withColumn("confirmed", F.col("similarity") >= CONTAINED).drop("tl_hash")


def _known(model: Classifier) -> Column:
    """The model's n-grams and all pairs and words of templates: all that scores and similarities ask for."""
    pairs = {p for ts in TEMPLATES.values() for t in ts for p in _pairs(t)}
    return F.array(*[F.lit(g) for g in sorted(pairs | set(model.vocabulary))])


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, paragraph, family, probability, similarity, confirmed, text."""
    common = corpus_words(docs)
    model = model or train(common)
    some = texts(docs, model, common)
    lines = keep(_scored(single(some, model, common), model), "lines")
    wide = _scored(wrapped(some, lines.where("confirmed").select("tl_row", "paragraph"), common), model).where("confirmed")
    out = keep(lines.unionByName(wide), "found")
    # wrapped notices: none that holds a confirmed paragraph of its family, and the most similar of overlapping ones
    ends = "paragraph + lines AS end"
    x = out.where("lines > 1").selectExpr("tl_row", "family", "paragraph", "lines", "similarity", ends)
    y = out.where("confirmed").selectExpr("tl_row", "family", "paragraph AS p", "lines AS n", "similarity AS s", "paragraph + lines AS e")
    worse = x.join(y, ["tl_row", "family"]).where("(p >= paragraph and e <= end and n < lines) or (p < end and e > paragraph and not (p <= paragraph and e >= end) and (s > similarity or s = similarity and p < paragraph))")
    out = out.join(worse.select("tl_row", "family", "paragraph", "lines").distinct(), ["tl_row", "family", "paragraph", "lines"], "left_anti")
    return out.select("doc_id", F.col("paragraph").cast("long"), "family", "probability", "similarity", "confirmed", "text")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
