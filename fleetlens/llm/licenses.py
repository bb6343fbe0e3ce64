"""Licence scans: TF-IDF cosine of notices to templates, then inheritance down the directories.

Every line of a file is a candidate notice, wherever it stands; a licence file is also compared as
a whole.  Weights come from the number of lines of the whole corpus that hold each template word;
any other word weighs as one that no line holds, so text that is not of a notice lowers the cosine.
A file without a notice inherits from the licence file of its nearest ancestor directory.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import save

#: Notices by licence (fixed values): the sentences that grant it, several for one licence.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
        "in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
}
#: Least cosine of a notice.
COSINE = 0.7
#: What separates words (Java and Python read it alike); a word is lower-cased.
BETWEEN = r"[^a-z0-9]+"


def template_words(text: str) -> list[str]:
    """Words of a template: runs of a-z and 0-9 of the lower-cased text."""
    words, now = [], ""
    for c in text.lower() + " ":
        if "a" <= c <= "z" or "0" <= c <= "9":
            now += c
        elif now:
            words.append(now)
            now = ""
    return words


def _line_words(files: DataFrame) -> DataFrame:
    """``path`` and the ``words`` of every line that has one; letters are lower-cased, a-z and 0-9
    of the result are the letters of words."""
    lines = files.select("path", F.explode(F.split(F.col("text"), "\n")).alias("line"))
    words = F.filter(F.split(F.lower("line"), BETWEEN), lambda w: w != "")
    return lines.select("path", words.alias("words"))


def notice_weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Weight of every template word and of any other: log((1 + lines) / (1 + lines with it)) + 1.

    One row for each template word reaches the driver.
    """
    words = _line_words(files)
    hits = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    # Lines without a template word count as well: the null word.
    rows = (
        words.select(F.explode_outer(hits).alias("word"), (F.size(hits)).alias("_n"))
        .select("word", (1 / F.greatest(F.col("_n"), F.lit(1))).alias("_part"))
        .groupBy("word")
        .agg(F.count("*").alias("lines"), F.sum("_part").alias("part"))
        .collect()
    )
    total = round(sum(r.part for r in rows))
    held = {r.word: r.lines for r in rows}
    weight = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {w: weight(held.get(w, 0)) for w in vocabulary}, weight(0)


def _lookup(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(words: str, value: Callable[[Column], Column]) -> Column:
    """Sum of ``value`` over the words of an array column."""
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(value(w), F.lit(0.0)))


def _dot(template: str, weights: dict[str, float], table: Column) -> Column:
    """Dot product of the template words ``hits`` of a unit with a template's unit vector."""
    own = {w: n * weights[w] for w, n in Counter(template_words(template)).items()}
    length = math.sqrt(sum(v * v for v in own.values()))
    vector = _lookup({w: v / length for w, v in own.items()})
    return _total("hits", lambda w: F.try_element_at(vector, w) * F.try_element_at(table, w))


def notices(
    units: DataFrame,
    weights: dict[str, float],
    other: float,
    templates: Mapping[str, tuple[str, ...]],
    least: float,
) -> DataFrame:
    """``path, licence, cosine`` of the best notice of every path that has one.

    ``units``: path and words.  A word outside the templates is a term of its own.  The cosine is
    at most the template words' share of a unit's length, so a unit below ``least`` by that alone
    is not compared with any template.
    """
    table = _lookup(weights)
    vocabulary = F.array(*[F.lit(w) for w in weights])

    def measure(inside: Column, hits: Column) -> Column:
        share = F.aggregate(
            inside,
            F.lit(0.0),
            lambda acc, w: acc
            + F.pow(F.size(F.filter(hits, lambda x: x == w)) * F.try_element_at(table, w), F.lit(2.0)),
        )
        outside = F.size("words") - F.size(hits)
        return F.struct(hits.alias("hits"), outside.alias("outside"), share.alias("share"))

    # Values used within lambdas are bound once for a row; inline() keeps them from being repeated.
    measured = _let(
        F.array_intersect("words", vocabulary),
        lambda inside: _let(
            F.filter("words", lambda w: F.array_contains(inside, w)), lambda hits: measure(inside, hits)
        ),
    )
    measured = (
        units.where(F.arrays_overlap("words", vocabulary))
        .select("path", F.inline(F.array(measured)))
        .withColumn("length", F.sqrt(F.col("share") + F.col("outside") * F.lit(other**2)))
        .where(F.sqrt("share") >= least * F.col("length"))
    )
    scored = [
        F.struct((_dot(t, weights, table) / F.col("length")).alias("cosine"), F.lit(name).alias("licence"))
        for name, texts in templates.items()
        for t in texts
    ]
    best = measured.select("path", F.array_max(F.array(*scored)).alias("best"))
    good = best.where(F.col("best.cosine") >= least).groupBy("path").agg(F.max("best").alias("best"))
    return good.select("path", F.col("best.licence").alias("licence"), F.col("best.cosine").alias("cosine"))


def scan_licenses(
    files: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    least: float = COSINE,
) -> DataFrame:
    """A row per distinct path: path, licence, origin, declared_in and cosine.

    ``files``: path (directories separated by "/"), text, licence_file (boolean).  origin is
    ``notice`` (a line of the file), ``directory`` (inherited from the licence file declared_in of
    the nearest ancestor directory, the smallest path of several) or ``none``.  The best notice is
    that of the largest cosine, ties to the larger licence name.  A null text has no notice, null
    paths take no part, rows of one path are parts of one file, a null licence_file is false, and
    an empty table gives no rows.  Other columns play no part.
    """
    files = files.where("path IS NOT NULL").select(
        F.col("path").cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
    )
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in template_words(t)})
    weights, other = notice_weights(files, vocabulary)
    whole = files.where("licence_file").select(
        "path", F.filter(F.split(F.lower("text"), BETWEEN), lambda w: w != "").alias("words")
    )
    units = _line_words(files).union(whole)
    found = save(notices(units, weights, other, templates, least), "notices")
    paths = save(files.groupBy("path").agg(F.max("licence_file").alias("licence_file")), "paths")
    own = paths.join(found.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left").drop("_p")
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    declared = (
        own.where("licence_file AND licence IS NOT NULL")
        .groupBy(directory.alias("dir"))
        .agg(F.min(F.struct("path", "licence")).alias("d"))
    )
    # Distinct directories, few beside files, each with all its ancestors; "" is the top.
    ancestors = F.expr(
        "transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))"
    )
    nearest = (
        own.select(directory.alias("dir"))
        .distinct()
        .withColumn("above", F.explode(ancestors))
        .join(declared.withColumnRenamed("dir", "_d"), F.col("above") == F.col("_d"))
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "d")).alias("n"))
        .select(F.col("dir").alias("_dir"), F.col("n.d.path").alias("_from"), F.col("n.d.licence").alias("_licence"))
    )
    return own.join(nearest, directory == F.col("_dir"), "left").select(
        "path",
        F.coalesce("licence", "_licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "notice")
        .when(F.col("_licence").isNotNull(), "directory")
        .otherwise("none")
        .alias("origin"),
        F.when(F.col("licence").isNull(), F.col("_from")).alias("declared_in"),
        "cosine",
    )
