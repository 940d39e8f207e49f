"""Licence scans: a trained paragraph classifier names licence families, templates confirm it.

Features are word n-grams (one and two words). A softmax regression is trained here on variants of the
templates below, on remarks that only mention or deny licences, and on a bounded sample of the corpus' own paragraphs
(``NEGATIVES``); the last two are the unknown class. N-grams that ordinary paragraphs hold are left out, so the
weights are a sparse table. Its confidence is calibrated on held-out variants and paragraphs: the threshold
is the least at which no held-out paragraph of the unknown class is named. A named paragraph is confirmed if it
holds enough of the n-grams of one of the family's templates, or all of one of its short forms; if not, it is reported as unknown. A paragraph with a word that denies or excepts is not confirmed by a
notice without such a word, and a short form needs a word that gives a licence beside it, or to stand nearly alone.

Rows are handled by DataFrame functions alone: paragraphs (lines with words) explode to n-grams, which meet
the weights in a broadcast join - their number is bounded by the templates - and sums per
paragraph are pre-aggregated. Only paragraphs with features are shuffled.

Defined cases: null and empty texts and an empty table have no paragraphs; repeated rows are reported each (a row number
keeps them apart), rows without an id with a null one; ties go to the family first in ``TEMPLATES``; without a corpus to sample only the remarks
teach the unknown class; texts of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sampled, text_or_empty

#: Ordinary paragraphs that the unknown class learns from (expected number), share of a template that confirms.
NEGATIVES, CONFIRM = 2000, 0.6
#: An n-gram that more than this share of the ordinary paragraphs holds is no feature.
COMMON = 0.002
ROUNDS, STEP, DECAY = 300, 1.0, 1e-4
UNKNOWN = "unknown"

# Short notices of licence families, as they are commonly written.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "This project is licensed under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This software is distributed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "Distributed under the terms of the GNU General Public License version 2 or later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "Distributed under the GNU LGPL v2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause license.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This file is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under CC BY-SA 4.0."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Short forms of notices. So few n-grams confirm a paragraph only if it holds them all.
SHORT_FORMS = {
    "apache": ["Apache License, Version 2.0"],
    "mit": ["Permission is hereby granted, free of charge"],
    "gpl": ["GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License"],
    "agpl": ["GNU Affero General Public License"],
    "bsd": ["Redistribution and use in source and binary forms"],
    "mpl": ["Mozilla Public License"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential."],
}
# Remarks that mention licences without giving one.
REMARKS = [
    "He renewed the licence of his car last week.", "A driving license is needed.", "See the licence terms of your vendor.", "The general public was invited.", "The license fee rose by three percent.",
    "Version 2.0 of the report was released in May.", "The work is released under the name of the editor.", "A license agreement may apply to this product.", "Version 3 is distributed to all members.", "Copyright notices are kept in a separate file.",
]
# Remarks that deny, compare or discuss licences by their names.
DENIALS = [
    "This project is not released under the MIT License.", "This software is not licensed under the GNU General Public License.", "It is no longer distributed under the Apache License, Version 2.0.",
    "The article compares the MIT License with the Apache License, Version 2.0.", "Unlike the BSD License, the GNU General Public License is a copyleft licence.", "We do not use the Creative Commons Attribution License here.",
    "Nothing here is released under the Mozilla Public License.", "Read why the GNU Lesser General Public License was replaced.", "This file is not licensed under CC BY 4.0.", "The package was never released under the BSD 3-Clause License.",
]

# Words that deny or except, and words that give a licence or claim a right.
DENYING = sorted("not no never nor neither without cannot isn aren wasn weren doesn don didn won hasn haven excluded excludes exclude excluding except exempt unlike instead".split())
GIVING = sorted("licensed released distributed copyright copyrighted c spdx-license-identifier subject terms granted permitted available provided governed dedicated".split())

_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams(text: str) -> set[str]:
    w = words(text)
    return {*w, *(" ".join(p) for p in zip(w, w[1:]))}


def _variants(notice: str, rng: random.Random) -> list[str]:
    """The notice as it stands, shortened at either end, and with words before and after it."""
    w = notice.split()
    out = [notice]
    for _ in range(5):
        a, b = rng.randrange(1 + len(w) // 6), rng.randrange(1 + len(w) // 6)
        out.append(" ".join(["note"] * rng.randrange(2) + w[a : len(w) - b] + ["2021", "authors"][: rng.randrange(3)]))
    return out


def train(paragraphs: list[str], seed: int = 7) -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(families, weights by n-gram, biases, threshold of confidence); the unknown class is the last one."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    seen: dict[str, int] = {}
    for p in paragraphs:
        for g in grams(p):
            seen[g] = seen.get(g, 0) + 1
    rows = [(grams(v), families.index(f)) for forms in (TEMPLATES, SHORT_FORMS) for f, notices in forms.items() for t in notices for v in _variants(t, rng)]
    rows += [(grams(v), len(families) - 1) for t in REMARKS + DENIALS for v in _variants(t, rng)]
    rows += [(grams(p), len(families) - 1) for p in paragraphs]
    rng.shuffle(rows)
    held, taught = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    denying = {g for t in DENIALS for g in grams(t) if " " in g}
    named = sorted({g for gs, y in taught for g in gs if (y < len(families) - 1 or g in denying) and seen.get(g, 0) <= COMMON * max(1, len(paragraphs))})
    at = {g: i for i, g in enumerate(named)}

    def matrix(part: list[tuple[set[str], int]]) -> np.ndarray:
        x = np.zeros((len(part), len(named)))
        for i, (gs, _) in enumerate(part):
            x[i, [at[g] for g in gs if g in at]] = 1
        return x

    x, y = matrix(taught), np.array([r[1] for r in taught])
    w, b = np.zeros((len(named), len(families))), np.zeros(len(families))
    weight = 1 / len(y)
    goal = np.eye(len(families))[y]
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - goal) * weight
        dw, db = x.T @ d + DECAY * w, d.sum(axis=0)
        gw += dw * dw
        gb += db * db
        w -= STEP * dw / np.sqrt(gw)
        b -= STEP * db / np.sqrt(gb)
    z = matrix(held) @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True))[:, :-1]
    unknown = np.array([r[1] == len(families) - 1 for r in held], bool)
    threshold = max(0.5, float(p[unknown].max()) + 1e-6 if unknown.any() else 0.5)
    return families, {g: w[i].tolist() for g, i in at.items()}, b.tolist(), threshold


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, line, words of each line with words."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line", "paragraph"))
    found = lines.select("row", "doc_id", "line", F.regexp_extract_all(F.lower("paragraph"), F.lit(_WORD), F.lit(0)).alias("words")).filter("size(words) > 0")
    has = lambda listed: F.arrays_overlap("words", F.array(*map(F.lit, listed)))
    return found.withColumn("said", F.struct(F.size("words").alias("n"), has(DENYING).alias("denies"), has(GIVING).alias("gives")))


def _sample(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Ordinary paragraphs (none that speaks of licences), one of each document that a hash of id and text chooses."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = sampled(rows, rows.count(), NEGATIVES, "id", "text")
    lines = some.select(F.explode(F.slice(F.shuffle(F.split(text_or_empty("text"), "\n"), F.lit(11)), 1, 1)).alias("p"))
    return [r[0] for r in lines.filter("not lower(p) rlike 'licen|copyright|permission|rights|creative commons|proprietary|redistribut'").collect()]


_GRAMS = "concat(words, if(size(words) > 1, zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> concat(a, ' ', b)), array()))"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, family, confidence, similarity, confirmed: each paragraph that a family is named for, or would be but for a template."""
    spark = docs.sparkSession
    families, weights, bias, threshold = train(_sample(docs, id_col, text_col))
    table = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, w array<double>")  # the templates' n-grams
    notices = [(f, sorted(grams(t)), forms is SHORT_FORMS, len(words(t)), set(DENYING).isdisjoint(words(t))) for forms in (TEMPLATES, SHORT_FORMS) for f, ts in forms.items() for t in ts]
    notices = spark.createDataFrame(notices, "family string, template array<string>, short boolean, n int, plain boolean")
    hits = _paragraphs(docs, id_col, text_col).select("row", "doc_id", "line", "said", F.explode(F.array_distinct(F.expr(_GRAMS))).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("row", "doc_id", "line").agg(F.first("said").alias("said"), F.collect_set("gram").alias("held"), *[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(families))])
    z = [F.col(f"z{k}") + F.lit(bias[k]) for k in range(len(families))]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    best = F.coalesce(*[F.when(x == top, F.lit(f)) for x, f in zip(z, families)])
    judged = sums.select("row", "doc_id", "line", "held", "said", best.alias("family"), (1 / total).alias("confidence")).filter(F.col("family") != UNKNOWN)
    share = F.size(F.array_intersect("held", "known")) / F.size("known")
    # a notice that denies nothing itself is not confirmed by a paragraph that does; a short form needs a word that gives, or next to nothing beside it
    stands = ~(F.col("plain") & F.col("said.denies")) & (~F.col("short") | F.col("said.gives") | (3 * F.col("said.n") <= 4 * F.col("n")))
    share = F.when((~F.col("short") | (share == 1)) & stands, share)
    known = notices.join(F.broadcast(table.agg(F.collect_set("gram").alias("vocabulary")))).select("family", "short", "n", "plain", F.array_intersect("template", "vocabulary").alias("known")).filter("size(known) > 0")
    compared = judged.join(F.broadcast(known), "family", "left").withColumn("similarity", F.coalesce(share, F.lit(0.0)))
    first = compared.groupBy("row", "doc_id", "line").agg(F.first("family").alias("family"), F.first("confidence").alias("confidence"), F.max("similarity").alias("similarity"))
    confirmed = (F.col("confidence") >= threshold) & (F.col("similarity") >= CONFIRM)
    return first.select("doc_id", F.col("line").cast("long").alias("line"), F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"), F.round("confidence", 6).alias("confidence"), F.round("similarity", 6).alias("similarity"), confirmed.alias("confirmed"))
