"""License scans (operator 8): a trained classifier of paragraphs, confirmed by templates.

Lines are scanned, and paragraphs of the lines between blank ones. Word 2- and 3-grams are the features of a sparse logistic regression over
licence families and an unknown class, trained on the notices below, on parts of them amid
other words, and on sentences that only look like notices. A threshold calibrated on those
decides between the best family and unknown; a family is reported only if the paragraph also
holds most n-grams of one of its notices. Scanning uses DataFrame functions only; the model is
a table of a few thousand n-grams, whose size the notices bound.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import settled, without

#: Notices by family, as licensors word them.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}
#: Sentences that share words with notices and license nothing.
OTHERS = (
    "He lost his driver license and had to apply for a new one at the office.",
    "Version 2.0 of the program was released under great pressure of time.",
    "The general public was not admitted to the work on the new license plates.",
    "She is a licensed nurse under the law of the state, version of the board or not.",
    "A copy of this letter was found in the file of the free person.",
    "You may obtain a copy of the report at the counter of the public library.",
    "The foundation published the terms of the grant and any later version of it.",
    "The city released the names under the act; this work is now in compliance with the rules.",
    "Use of this road is governed by a common rule that can be found on the board.",
    "The right to use the software was a question of the source and the conditions.",
)
UNKNOWN = "unknown"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


@dataclass(frozen=True)
class Model:
    """Weights by n-gram and family over the unknown class, biases, the least probability of a
    family (calibrated), the n-grams of each notice, and the share of them that confirms."""

    weights: dict[str, dict[str, float]]
    bias: dict[str, float]
    threshold: float
    notices: tuple[tuple[str, str, int], ...]
    confirm: float


def _examples(seed: int) -> list[tuple[str, set[str]]]:
    """Notices, whole and with words lost or others before and after; and what licenses nothing:
    ordinary sentences, and short parts of notices. All from a fixed seed."""
    rng = random.Random(seed)
    filler = sorted({w for s in OTHERS for w in words_of(s)})
    around = lambda: " ".join(rng.choice(filler) for _ in range(rng.randint(2, 12)))
    out = []
    for family, texts in NOTICES.items():
        for text in texts:
            w = words_of(text)
            out += [(family, grams_of(text)), (family, grams_of(f"{around()} {text} {around()}"))]
            for _ in range(6):
                lost = [x for x in w if rng.random() > 0.06]
                out.append((family, grams_of(f"{around()} {' '.join(lost)} {around()}")))
            for _ in range(3):
                size = max(2, len(w) // 3)
                at = rng.randrange(max(1, len(w) - size))
                out.append((UNKNOWN, grams_of(f"{around()} {' '.join(w[at : at + size])} {around()}")))
    out += [(UNKNOWN, grams_of(s)) for s in OTHERS] + [(UNKNOWN, grams_of(around())) for _ in range(60)] + [(UNKNOWN, set())] * 20
    return out


def fit(seed: int = 5, rounds: int = 60, rate: float = 0.3, penalty: float = 1e-3, confirm: float = 0.6) -> Model:
    """Train on the examples by stochastic descent and calibrate the threshold on fresh ones.

    The vocabulary is the notices' n-grams. The threshold is the smallest that keeps at least
    99 of 100 fresh examples of the unknown class unknown.
    """
    vocabulary = {g for texts in NOTICES.values() for t in texts for g in grams_of(t)}
    families = [*NOTICES, UNKNOWN]
    weights: dict[str, dict[str, float]] = defaultdict(lambda: dict.fromkeys(NOTICES, 0.0))
    bias = dict.fromkeys(families, 0.0)
    rng, examples = random.Random(seed), [(f, g & vocabulary) for f, g in _examples(seed)]
    for turn in range(rounds):
        rng.shuffle(examples)
        pace = rate / (1 + turn / 10)
        for family, grams in examples:
            p = _chances({f: bias[f] + sum(weights[g][f] for g in grams) for f in NOTICES} | {UNKNOWN: bias[UNKNOWN]})
            for f in NOTICES:
                step = pace * ((f == family) - p[f])
                for g in grams:
                    weights[g][f] += step / math.sqrt(len(grams)) - pace * penalty * weights[g][f]
                bias[f] += pace * 0.1 * ((f == family) - p[f])
            bias[UNKNOWN] += pace * 0.1 * ((family == UNKNOWN) - p[UNKNOWN])
    strays = []
    for family, grams in ((f, g & vocabulary) for f, g in _examples(seed + 1)):
        if family == UNKNOWN:
            p = _chances({f: bias[f] + sum(weights[g][f] for g in grams) for f in NOTICES} | {UNKNOWN: bias[UNKNOWN]})
            strays.append(max(p[f] for f in NOTICES))
    strays.sort()
    threshold = min(0.9, max(0.5, strays[int(0.99 * (len(strays) - 1))]))
    notices = tuple((f, t, len(grams_of(t))) for f, texts in NOTICES.items() for t in texts)
    return Model({g: weights[g] for g in sorted(vocabulary)}, bias, threshold, notices, confirm)


def _chances(scores: dict[str, float]) -> dict[str, float]:
    top = max(scores.values())
    shares = {f: math.exp(s - top) for f, s in scores.items()}
    whole = sum(shares.values())
    return {f: s / whole for f, s in shares.items()}


def _tables(spark: SparkSession, model: Model) -> DataFrame:
    """(gram, weights array in family order, notices that hold it): one row for each n-gram of the notices."""
    families = list(NOTICES)
    held = defaultdict(list)
    for k, (_, text, _) in enumerate(model.notices):
        for g in grams_of(text):
            held[g].append(k)
    rows = [(g, [w[f] for f in families], held[g]) for g, w in model.weights.items()]
    return spark.createDataFrame(rows, "gram string, w array<double>, held array<int>")


def _scored(met: DataFrame, unit: list[str], model: Model, name: str) -> DataFrame:
    """(*unit, family, score, coverage) of the grams (*unit, gram) of lines or paragraphs."""
    families = list(NOTICES)
    met = met.select(*unit, "gram").distinct().join(F.broadcast(_tables(met.sparkSession, model)), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(families))]
    counts = [F.count_if(F.array_contains("held", k)).alias(f"c{k}") for k in range(len(model.notices))]
    found = met.groupBy(*unit).agg(*sums, *counts)
    # Written once: what follows is computed on a few short rows, apart from the aggregation's code.
    found = settled(found.select(*unit, F.array(*[f"s{k}" for k in range(len(families))]).alias("s"), F.array(*[f"c{k}" for k in range(len(model.notices))]).alias("c")), name)
    biases = F.array(*[F.lit(model.bias[f]) for f in families])
    raised = F.zip_with("s", biases, lambda s, b: F.exp(s + b))
    found = found.withColumn("e", raised).withColumn("whole", F.aggregate("e", F.lit(math.exp(model.bias[UNKNOWN])), lambda a, x: a + x))
    own = F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(size).alias("n")) for k, (g, _, size) in enumerate(model.notices) if g == f]) for f in families])
    covers = F.transform(own, lambda many: F.array_max(F.transform(many, lambda x: F.get("c", x["k"]) / x["n"])))
    named = F.zip_with("e", F.array(*[F.lit(f) for f in families]), lambda e, f: F.struct(e.alias("p"), f.alias("f")))
    options = F.zip_with(named, covers, lambda x, c: F.struct((x["p"] / F.col("whole")).alias("p"), x["f"].alias("f"), c.alias("c")))
    best = found.select(*unit, F.array_max(options).alias("b"))
    sure: Column = (F.col("b.p") >= model.threshold) & (F.col("b.c") >= model.confirm)
    return best.select(*unit, F.when(sure, F.col("b.f")).otherwise(F.lit(UNKNOWN)).alias("family"), F.col("b.p").alias("score"), F.col("b.c").alias("coverage"))


def _grams(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, row, block, line, last, gram): the notices' n-grams with the lines of their first and
    last word, and the number of blank lines before them, which tells their paragraph."""
    row = F.xxhash64(F.col(text)).alias("row")
    docs = df.filter(F.length(text) > 0).select(F.col(key).alias("key"), row, F.split(F.lower(text), "\n", -1).alias("lines")).dropDuplicates(["key", "row"])
    blank = lambda x: ~x.rlike(r"(?U)\S")
    # A blank line stands as one empty word, which is in no n-gram of a notice.
    cut = F.transform("lines", lambda x: F.when(blank(x), F.array(F.lit(""))).otherwise(F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "")))
    docs = docs.withColumn("cut", cut).withColumn("w", F.flatten("cut"))
    n = F.size("w")
    # The words are arguments of zip_with only: a filter that Spark moves below them stays linear.
    two = F.zip_with("w", F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice("w", 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    known = sorted(g for g in model.weights if g.count(" ") == 1)
    # Only 2-grams of notices can begin their 3-grams, so the few that stay tell where to look.
    met = F.zip_with(two, three, lambda g, t: F.when(g.isin(known), F.struct(g.alias("g"), t.alias("t"))))
    at = F.filter(F.transform(met, lambda x, i: F.when(x.isNotNull(), F.struct(x["g"].alias("g"), x["t"].alias("t"), i.alias("i")))), lambda x: x.isNotNull())
    where = F.flatten(F.transform("cut", lambda own, i: F.array_repeat(i, F.size(own))))
    blanks = F.filter(F.transform("lines", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    hits = docs.select("key", "row", where.alias("where"), blanks.alias("blanks"), at.alias("at")).filter(F.size("at") > 0)
    hits = hits.select("key", "row", "where", "blanks", F.explode("at").alias("x"))
    line, next_, third = (F.get("where", F.col("x.i") + k) for k in range(3))
    block = F.size(F.filter("blanks", lambda b: b < line))
    both = F.array(F.struct(F.col("x.g").alias("gram"), next_.alias("last")), F.struct(F.col("x.t").alias("gram"), third.alias("last")))
    grams = hits.select("key", "row", block.alias("block"), line.alias("line"), F.explode(both).alias("y")).select("key", "row", "block", "line", "y.last", "y.gram")
    return grams.filter(F.col("gram").isin(sorted(model.weights)))


def scan(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_findings() without the hash of the text: a row for each line, and each paragraph of lines, that holds an n-gram of a notice: key, line
    (from 0; of a paragraph the first that holds one), last (the last such line), family (or
    unknown), score (probability of the best family) and coverage (share of the n-grams of that
    family's notice that it holds most of).

    A family is given if its probability is at least the model's threshold and the coverage at
    least model.confirm. Lines up to the next blank one are a paragraph, so wrapped notices are
    found over line ends; lines that are a notice by themselves are left out of theirs. What
    holds none of the model's features is unknown without exception and has no row. Null and
    empty texts have no lines. Rows that repeat a key and a text are scanned once.
    """
    return _findings(df, model, key, text).select(F.col("key").alias(key), "line", "last", "family", "score", "coverage")


def _findings(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, row, line, last, family, score, coverage): the findings of each key and text (row: its hash)."""
    grams = settled(_grams(df, model, key, text), "license-grams")
    lines = _scored(grams.filter("line = last"), ["key", "row", "line"], model, "license-sums")
    sure = settled(lines.filter(F.col("family") != UNKNOWN).select(F.col("key").alias("k"), F.col("row").alias("r"), F.col("line").alias("own")), "license-lines")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))
    rest = grams
    for end in ("line", "last"):
        rest = rest.join(sure, same & (F.col(end) == F.col("own")), "left_anti")
    paragraph = ["key", "row", "block"]
    rest = settled(rest, "license-rest")
    reach = rest.groupBy(*paragraph).agg(F.min("line").alias("line"), F.max("last").alias("last")).filter("line < last")
    span = reach.select(F.col("key").alias("k"), F.col("row").alias("r"), F.col("block").alias("b"), "line", "last")
    blocks = _scored(rest.drop("line", "last").join(span, same & (F.col("block") == F.col("b"))), [*paragraph, "line", "last"], model, "license-sums")
    rows = lines.withColumn("last", F.col("line")).unionByName(blocks.drop("block"))
    return rows.select("key", "row", "line", "last", "family", "score", "coverage")


def licensed(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with `licenses` (the families found in the row's lines and paragraphs, sorted) and
    `n_license_lines`, for which a notice over several lines counts once.

    Columns of these names are replaced; rows without a finding have an empty list and 0.
    """
    found = _findings(df, model, key, text).filter(F.col("family") != UNKNOWN).groupBy(F.col("key").alias("__key"), F.col("row").alias("__row"))
    found = found.agg(F.array_sort(F.collect_set("family")).alias("licenses"), F.countDistinct("line").alias("n_license_lines"))
    # Rows of one key and different texts have findings of their own.
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__row"))
    rows = without(df, ["licenses", "n_license_lines"]).join(settled(found, "licenses"), same, "left").drop("__key", "__row")
    return rows.withColumns({"licenses": F.coalesce("licenses", F.array().cast("array<string>")), "n_license_lines": F.coalesce("n_license_lines", F.lit(0)).cast("long")})
