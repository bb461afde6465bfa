"""Licence scan: a trained paragraph classifier with template comparison.

A paragraph is a line. Its features are word 1- to 3-grams; a multinomial logistic regression with an L1
penalty, trained here by Spark ML on the templates below, on edits of them (words left out, halves, words of the corpus around
them) and on half of the corpus's own lines, told by a hash, as the class unknown, keeps a sparse table of weights. A paragraph's scores are sums over the weights
of its n-grams, found by an equi-join; softmax gives the families' chances. A paragraph is unknown unless its best
family's chance reaches a threshold calibrated on the corpus's other lines, all of them (the highest chance that
CALIBRATE of them stay under), and unless the n-grams of the family's templates confirm it.

Notices also stand within longer lines, so what is classified is each line and, in it, each window of about a
template's length that holds at least ``agree`` of that template's word pairs. A window is confirmed by the share of the
template's pairs that it holds, whatever stands around it; a line also by the share of its own pairs that stand in the
templates of the family. A line names every family that it or one of its windows is confirmed for.

Only paragraphs that hold a kept n-gram can score above the constant terms, which make a paragraph unknown; the others
are passed over before n-grams move. Every step is a DataFrame expression or Spark ML.

Nulls and odd input: null or empty text has no paragraph and no licence. Rows that repeat are each reported. Of families with the same score
the last by name is taken. Very long lines cost in proportion and are looked at by windows. An empty
table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, cut

#: Notices by which the public licences ask to be named, a family each.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "This software is released under the 2-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
UNKNOWN = "unknown"
CALIBRATE, AGREE = 0.999, 0.6
GRAM_WORDS = 3
#: Ids of documents with a licence up to this many are broadcast.
BROADCAST_DOCS = 1_000_000


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, at, words) of every line that has words.

    Words are taken within the generator, which no filter passes: each line is matched once, whatever follows.
    """
    lines = documents.select(F.col("doc_id"), F.posexplode(F.transform(F.split("text", "\n"), _words)).alias("at", "words"))
    return lines.where(F.size("words") > 0)


def units(lines: DataFrame, agree: float = AGREE) -> DataFrame:
    """(doc_id, at, line, whole, words) of paragraphs(doc_id, at, words): each line, and its windows like a template.

    line is a hash of the whole line's words.
    """
    each = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("words").alias("words"))), F.transform(_windows(F.col("words"), agree), lambda w: F.struct(F.lit(False).alias("whole"), w.alias("words"))))
    return lines.select("doc_id", "at", F.xxhash64("words").alias("line"), F.explode(each).alias("x")).select("doc_id", "at", "line", "x.whole", "x.words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, agree: float) -> Column:
    """The distinct stretches of words, from one of a template's pairs to another, that hold agree of its pairs.

    A stretch has at most a quarter and one word more than the template.
    """
    templates = [list(map(str.lower, re.findall(r"[^\W_]+(?:\.[0-9]+)*", t))) for texts in TEMPLATES.values() for t in texts]
    pairs = [sorted(set(zip(t, t[1:], strict=False))) for t in templates]
    every = sorted(set().union(*pairs))
    known = F.array(
        *(
            F.struct(F.array(*(F.lit(f"{a} {b}") for a, b in p)).alias("pairs"), F.lit(math.ceil(agree * len(p) - 1e-9)).alias("least"), F.lit(len(t) + len(t) // 4 - 1).alias("reach"))
            for t, p in zip(templates, pairs, strict=True)
        )
    )
    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    begins = F.filter(places, lambda i: F.get(words, i).isin(sorted({a for a, _ in every})))
    hits = F.filter(F.transform(begins, lambda i: F.struct(i.alias("i"), pair(i).alias("pair"))), lambda x: x["pair"].isin([f"{a} {b}" for a, b in every]))

    def near(own: Column, t: Column) -> Column:
        # Of the hits, which are in order, those within reach are among the next reach + 1.
        inside = lambda x, k: F.filter(F.slice(own, k + 1, t["reach"] + 1), lambda y: y["i"] <= x["i"] + t["reach"])
        span = lambda x, v: F.struct(x["i"].alias("s"), F.array_max(v)["i"].alias("e"), F.size(F.array_distinct(v["pair"])).alias("k"))
        return F.filter(F.transform(own, lambda x, k: _let(inside(x, k), lambda v: span(x, v))), lambda w: w["k"] >= t["least"])

    spans = lambda h: F.flatten(F.transform(known, lambda t: _let(F.filter(h, lambda x: F.array_contains(t["pairs"], x["pair"])), lambda own: near(own, t))))
    none = F.array().cast("array<array<string>>")
    cuts = lambda h: F.transform(spans(h), lambda w: F.slice(words, w["s"] + 1, w["e"] - w["s"] + 2))
    return _let(hits, lambda h: F.when(F.size(h) > 1, F.array_distinct(cuts(h))).otherwise(none))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def _grams(words: Column, most: int = GRAM_WORDS, least: int = 1) -> Column:
    """Distinct word n-grams of a word array."""
    starts = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    gram = lambda n: F.transform(starts(n), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))
    return F.array_distinct(F.concat(*(gram(n) for n in range(least, most + 1))))


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, line string").select("family", _words(F.col("line")).alias("words"))


def _edits(words: Column) -> Column:
    """A notice as it stands and as it is found: without its first word, with words left out, and its halves."""
    n, half = F.size(words), F.ceil(F.size(words) / 2).cast("int")
    thinned = lambda step: F.filter(words, lambda _, i: (i + 2) % step != 0)
    gaps = [thinned(step) for step in (3, 4, 5, 7)]
    halves = [F.when(n >= 12, F.slice(words, F.lit(1), half)).otherwise(words), F.when(n >= 12, F.slice(words, half + 1, n)).otherwise(words)]
    return F.array(words, F.slice(words, F.lit(2), n), *gaps, *halves)


def _least_chance(constants: dict[str, float]) -> float:
    """The best family's chance where no n-gram speaks."""
    top = max(constants.values())
    each = {k: math.exp(v - top) for k, v in constants.items()}
    return max((v for k, v in each.items() if k != UNKNOWN), default=0.0) / sum(each.values())


def train(documents: DataFrame) -> dict:
    """Weights (family, gram, weight), constants by family, and the calibrated threshold.

    Every line of the corpus is counted. Lines that hold the same n-grams of the templates are the same to the model: they are one row of
    what it learns from, weighed by how many they are, so that table grows with the templates' n-grams and hardly with the corpus.
    """
    spark = documents.sparkSession
    known = _template_rows(spark)
    phrases = {g for (g,) in known.select(F.explode(_grams(F.col("words"), 3, 3))).distinct().collect()}
    # An edit must keep a word that no other family's notices have.
    word = known.select("family", F.explode("words").alias("w")).distinct().groupBy("w").agg(F.min("family").alias("family"), F.count("*").alias("n"))
    own = word.where("n = 1").groupBy("family").agg(F.collect_set("w").alias("own"))
    edited = known.select("family", F.explode(_edits(F.col("words"))).alias("words")).where(F.size("words") > 1).distinct()
    parts = edited.join(F.broadcast(own), "family").where(F.arrays_overlap("words", "own")).drop("own")
    # Words of templates are the features, so the table's size is theirs.
    vocabulary = sorted({g for (g,) in parts.select(F.explode(_grams(F.col("words")))).distinct().collect()})
    # Lines of the corpus stand for the unknown class; a line that shares three words in a row with a template is none.
    # N-grams are taken within the generator, which no filter passes, so once.
    held = F.array(_held(F.col("words"), sorted(phrases.union(vocabulary))))
    unlike = F.transform(F.filter(held, lambda h: ~F.exists(h, lambda g: g.isin(sorted(phrases)))), lambda h: F.array_sort(h))  # noqa: PLW0108
    lines = paragraphs(documents).select(F.explode(unlike).alias("grams"), F.pmod(F.xxhash64("words"), F.lit(2)).alias("parity"))
    lines = cut(lines.groupBy("grams", "parity").agg(F.count("*").cast("double").alias("n")).withColumn("family", F.lit(UNKNOWN)), "unknown")
    unknown = lines.where("parity = 0")
    # Rows of the templates weigh as much as the unknown ones together.
    names = sorted([*TEMPLATES, UNKNOWN])
    index = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(float(k)))))
    n_known, n_unknown = parts.count(), unknown.agg(F.sum("n")).first()[0] or 0.0
    noted = parts.select("family", _grams(F.col("words")).alias("grams"), F.lit(max(n_unknown, 1.0) / max(n_known, 1)).alias("weight"))
    rows = noted.unionByName(unknown.select("family", "grams", F.col("n").alias("weight")))
    rows = cut(rows.select("grams", index[F.col("family")].alias("label"), "weight"), "training")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    model = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.5, standardization=False, weightCol="weight", family="multinomial").fit(vectors.transform(rows))
    matrix, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    have = {int(r[0]) for r in rows.select("label").distinct().collect()}
    weights = [(names[k], g, float(matrix[k, j])) for k in sorted(have) for j, g in enumerate(vocabulary) if abs(matrix[k, j]) > 1e-6]
    out = {"weights": weights, "constants": {names[k]: float(constants[k]) for k in sorted(have)}, "threshold": 0.5}
    # The other half of all lines, which the model has not seen.
    others = cut(lines.where("parity = 1").select(F.monotonically_increasing_id().alias("doc_id"), "grams", "n"), "others")
    kept = sorted({g for _, g, _ in weights})
    held = others.select("doc_id", F.lit(0).alias("at"), F.lit(0).cast("long").alias("fp"), F.filter("grams", lambda g: g.isin(kept)).alias("held"))
    found = _highest(_scored(held, out, spark).join(others, "doc_id").select("chance", "n"), CALIBRATE)
    # Paragraphs without a kept n-gram are passed over: the constants alone never reach the threshold.
    return out | {"threshold": max(0.5, found, _least_chance(out["constants"]) + 1e-9)}


def _highest(rows: DataFrame, share: float, bins: int = 10_000) -> float:
    """The highest chance among the lowest ``share`` of rows(chance, n), each of which stands for n; to 1 / bins squared.

    A histogram finds the bin, and a second one the place within it.
    """
    low, width, least = 0.0, 1.0 / bins, None
    for _ in range(2):
        at = F.least(F.floor((F.col("chance") - low) / width), F.lit(bins - 1)).cast("int")
        inside = rows.where((F.col("chance") >= low) & (F.col("chance") < low + width * bins)) if least is not None else rows
        counts = sorted(inside.groupBy(at.alias("at")).agg(F.sum("n").alias("n")).collect())  # bins rows
        if not counts:
            return low
        least = share * sum(c["n"] for c in counts) if least is None else least
        for c in counts:
            if c["n"] >= least:
                break
            least -= c["n"]
        low, width = low + c["at"] * width, width / bins
    return low + width * bins


def _held(words: Column, grams: list[str]) -> Column:
    """The distinct n-grams of a word array that are among grams, formed where one's first word stands."""
    first = sorted({g.split()[0] for g in grams})
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).isin(first))
    # At the end of a paragraph a slice is shorter, and the same as another.
    formed = F.flatten(F.transform(starts, lambda i: F.array(*(F.array_join(F.slice(words, i, F.lit(k)), " ") for k in range(1, GRAM_WORDS + 1)))))
    return F.array_distinct(F.filter(formed, lambda g: g.isin(grams)))


def _chances(rows: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """(doc_id, at, fp, family, chance) of paragraphs(doc_id, at, words) that hold a kept n-gram.

    fp is a hash of the words, which stay behind: only ids and sums move. N-grams are formed where a kept one's first
    word stands, and those that are kept go on to the join.
    """
    kept = sorted({g for _, g, _ in model["weights"]})
    return _scored(rows.select("doc_id", "at", F.xxhash64("words").alias("fp"), _held(F.col("words"), kept).alias("held")), model, spark)


def _scored(rows: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """``_chances`` of rows(doc_id, at, fp, held), held being the kept n-grams."""
    table = spark.createDataFrame(model["weights"] or [("", "", 0.0)], "family string, gram string, weight double")
    wide = table.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("family", "weight"))).alias("w"))
    # Each paragraph also has the empty n-gram, which counts how often it is repeated.
    wide = wide.where("gram <> ''").unionByName(spark.range(1).select(F.lit("").alias("gram"), F.create_map().cast("map<string, double>").alias("w")))
    names = sorted(model["constants"])
    counted = F.get(F.transform(F.array("held"), lambda h: F.when(F.size(h) > 0, F.concat(h, F.array(F.lit(""))))), F.lit(0))
    gram = rows.select("doc_id", "at", "fp", F.explode(counted).alias("gram"))
    hit = gram.join(F.broadcast(wide), "gram")  # as many rows as the templates have n-grams
    times = F.sum((F.col("gram") == "").cast("double"))
    sums = hit.groupBy("doc_id", "at", "fp").agg(*((F.sum(F.coalesce(F.try_element_at("w", F.lit(n)), F.lit(0.0))) / times).alias(f"s_{n}") for n in names))
    logits = F.array(*(F.struct((F.col(f"s_{n}") + F.lit(model["constants"][n])).alias("z"), F.lit(n).alias("family")) for n in names))

    def chosen(all_: Column) -> Column:
        """The best family and its chance, from all classes' scores."""
        best = F.array_max(F.filter(all_, lambda x: x["family"] != UNKNOWN))
        total = F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.exp(F.least(x["z"] - best["z"], F.lit(700.0))))
        return F.struct((1 / total).alias("chance"), best["family"].alias("family"))

    best = F.get(F.transform(F.array(logits), chosen), F.lit(0))
    return sums.withColumn("best", best).select("doc_id", "at", "fp", "best.family", "best.chance")


def scan(documents: DataFrame, model: dict | None = None, agree: float = AGREE) -> DataFrame:
    """(doc_id, paragraph, line, family, chance, agreement) of every paragraph and licence that it names.

    line is a hash of the paragraph's words.
    """
    spark = documents.sparkSession
    model = model or train(documents)
    found = cut(_chances(units(paragraphs(documents), agree), model, spark).where(F.col("chance") >= model["threshold"]), "found")
    # The words of the units found, from the documents that hold them.
    holders = found.select(F.col("doc_id").alias("_id")).distinct()
    texts = documents.select("doc_id", "text").join(broadcast_if(holders, holders.count(), BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    own = units(paragraphs(texts), agree).select(F.col("doc_id").alias("_id"), F.col("at").alias("_at"), F.xxhash64("words").alias("_fp"), "line", "whole", "words").distinct()
    found = found.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at")) & (F.col("fp") == F.col("_fp"))).select("doc_id", "at", "line", "whole", "words", "family", "chance")
    pairs = lambda w: F.when(F.size(w) < 2, w).otherwise(_grams(w, 2, 2))
    templates = _template_rows(spark).groupBy("family").agg(F.collect_list(pairs(F.col("words"))).alias("templates"))
    both = found.join(F.broadcast(templates), "family").withColumn("own", pairs(F.col("words")))
    line = F.when(F.col("whole"), F.size(F.array_intersect("own", F.flatten("templates"))) / F.size("own"))
    window = F.array_max(F.transform("templates", lambda t: F.when(~F.col("whole"), F.size(F.array_intersect("own", t)) / F.size(t))))
    confirmed = both.withColumn("agreement", F.coalesce(line, window)).where(F.col("agreement") >= agree)
    return confirmed.groupBy("doc_id", F.col("at").alias("paragraph"), "line", "family").agg(F.max("chance").alias("chance"), F.max("agreement").alias("agreement"))


def scan_documents(documents: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row of documents: doc_id, families (sorted), n_paragraphs that name one, and the best chance."""
    found = scan(documents, model).groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.count_distinct("paragraph", "line").alias("n_paragraphs"), F.max("chance").alias("chance"))
    docs = documents.select(F.col("doc_id"))
    out = docs.join(found.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "chance")
