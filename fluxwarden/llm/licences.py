"""Licence scans: normalised lines compared with licence templates by Dice coefficient over word bigrams.

Method: each non-empty line is normalised (ASCII lower case, words of letters and digits, one space between). Equal
normalised lines are scored once. For a line with a distinct bigrams and a template with b, Dice = 2c / (a + b) >= t
needs b between a * t / (2 - t) and a * (2 - t) / t, so a line meets only the templates of such sizes, in a join of
line sizes with a small table that lists the templates which each size allows; the survivors are compared by counting
common bigrams.

A notice that is wrapped over lines or stands within a line is found, with ``whole_text``, in windows of consecutive words of the whole normalised
text. A match has at least b * t / (2 - t) of the template's bigrams, so it holds one of some long words of the template
(anchors) without which too few are left; texts without any anchor have no match and aren't cut into words. In the
others, for templates of which the text has enough bigrams, all windows that begin and end with a bigram of the template
and are at most (2 - t) / t times as long as it are compared: a window with other ends has no higher score.

Everything is a DataFrame expression: no Python runs on executors. Templates are a fixed small list, so broadcast.

Defined results: null, empty and wordless texts have no licence (null, score 0); one-word lines have no bigrams and
never match; of equal scores the template first by name wins; n_lines counts lines that match as a whole, so it is 0 where only a
window matches; rows with equal id and text get the same result; extra columns are left out; an
empty table returns an empty one.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bind, keep_where, row_key, words_of

WORD = r"[0-9a-z]+"
MIN_DICE = 0.8
MAX_TEMPLATES = 10_000
#: Beyond this, every text is cut into words.
MAX_ANCHORS = 200
#: Usual licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "licence string, text string")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours; fewer than two words have none."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def least_common(size: int, min_dice: float) -> int:
    return max(1, math.ceil(size * min_dice / (2 - min_dice) - 1e-9))


def anchors(words: list[str], min_dice: float) -> set[str]:
    """Long words of a template: a text with none of them has fewer of its bigrams than a match needs."""
    left, out = set(zip(words, words[1:], strict=False)), set()
    need = least_common(len(left), min_dice)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) >= need:
            out.add(w)
            left = {g for g in left if w not in g}
    return out


def windows(grams: Column, t_grams: Column, need: Column, longest: Column, size: Column) -> Column:
    """The best Dice of a window of ``grams`` (a text's pairs in order) with a template; null if none has ``need`` of its pairs."""
    at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t_grams, g), i)), lambda i: i.isNotNull())

    def dice(start: Column, end: Column) -> Column:
        return bind(F.slice(grams, start + 1, end - start + 1), lambda w: F.lit(2) * F.size(F.array_intersect(w, t_grams)) / (F.size(F.array_distinct(w)) + size))

    def best(at: Column) -> Column:
        def from_start(start: Column, k: Column) -> Column:
            ends = F.filter(F.slice(at, k + need, longest), lambda end: end - start < longest)
            return F.array_max(F.transform(ends, lambda end: dice(start, end)))

        return F.array_max(F.transform(at, from_start))

    return bind(at, best)


def window_matches(docs: DataFrame, licences: DataFrame, min_dice: float) -> DataFrame:
    """key, licence, dice of the windows that match. ``docs``: key, text; ``licences``: licence, grams, pairs."""
    t = licences.select(F.col("licence"), F.col("grams").alias("t_grams"), F.size("grams").alias("t_n"), F.floor(F.col("pairs") * ((2 - min_dice) / min_dice) + 1e-9).cast("int").alias("longest"))
    t = t.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("t_n") * (min_dice / (2 - min_dice)) - 1e-9).cast("int")))
    d = docs.withColumn("w", words_of(ascii_lower(F.col("text")), WORD)).select("key", pairs("w").alias("g")).withColumn("distinct", F.array_distinct("g"))
    m = d.join(F.broadcast(t), F.size(F.array_intersect("distinct", "t_grams")) >= F.col("need"))
    m = m.select("key", "licence", windows(F.col("g"), F.col("t_grams"), F.col("need"), F.col("longest"), F.col("t_n")).alias("dice"))
    return keep_where(m, F.col("dice") >= min_dice)


def pairs(words: str) -> Column:
    w = F.col(words)
    both = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(both, 1, F.greatest(F.size(w) - 1, F.lit(0)))


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_dice: float = MIN_DICE, whole_text: bool = False) -> DataFrame:
    """With ``whole_text`` windows of the whole text are compared besides single lines. A row per document row: id, licence (the best match, else null), dice (its score, else 0), n_lines (lines with a
    match). ``licences``: licence, text; more than ``MAX_TEMPLATES`` rows aren't broadcast."""
    if not 0 < min_dice <= 1:
        raise ValueError("min_dice must be in (0, 1]")
    t = licences.select("licence", words_of(ascii_lower(F.col("text")), WORD).alias("w"))
    t = t.select("licence", bigrams(F.col("w")).alias("grams"), (F.size("w") - 1).alias("pairs"), "w").where(F.size("grams") > 0)
    n_templates = t.count()
    plain, part = t.drop("w"), F.pmod(F.xxhash64("licence", "grams"), F.lit(max(1, -(-n_templates // MAX_TEMPLATES))))
    known = set().union(*[anchors(r["w"], min_dice) for r in t.select("w").collect()]) if n_templates <= MAX_TEMPLATES else set()
    known = {w for w in known if not any(o in w for o in known - {w})}
    size = F.size("grams")
    lo, hi = F.ceil(size * (min_dice / (2 - min_dice)) - 1e-9), F.floor(size * ((2 - min_dice) / min_dice) + 1e-9)
    t = t.select("licence", F.col("grams").alias("t_grams"), F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("t_size"))
    if n_templates <= MAX_TEMPLATES:
        t = F.broadcast(t)
    key = row_key(F.col(id_col), F.col(text_col))
    d = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    # Only lines as long as some template can match: others go before their words are cut. An empty line stands for the document.
    if 0 < len(known) <= MAX_ANCHORS:
        low = F.lower("text")
        d = d.withColumn("text", bind(low, lambda x: F.when(reduce(or_, [x.contains(w) for w in sorted(known)]), F.col("text"))))
    found = [window_matches(d.select("key", "text").where(F.col("text").isNotNull()), plain.where(part == k), min_dice) for k in range(-(-n_templates // MAX_TEMPLATES) if whole_text else 0)]
    lines = F.concat(F.array(F.lit("")), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 2))
    d = d.select("id", "key", F.posexplode(lines).alias("at", "line"))
    d = d.withColumn("grams", bigrams(words_of(ascii_lower(F.col("line")), WORD))).withColumn("size", F.size("grams"))
    m = d.join(t, d["size"] == t["t_size"], "left")
    common = F.size(F.array_intersect("grams", "t_grams"))
    m = m.withColumn("dice", F.when(F.col("licence").isNotNull(), F.lit(2) * common / (F.col("size") + F.size("t_grams"))))
    m = m.where((F.col("at") == 0) | (F.col("dice") >= min_dice))
    m = m.select("key", "id", "at", "licence", "dice")
    for f in found:
        m = m.unionByName(f.withColumn("at", F.lit(-1)), allowMissingColumns=True)
    hit = F.col("dice") >= min_dice
    best = F.min(F.when(hit, F.struct((-F.col("dice")).alias("d"), F.col("licence").alias("licence"))))
    m = m.groupBy("key").agg(F.first("id", ignorenulls=True).alias("id"), best.alias("best"), F.count_distinct(F.when(hit & (F.col("at") >= 0), F.col("at"))).alias("n_lines"), F.count_if((F.col("at") == 0) & ~F.coalesce(hit, F.lit(False))).alias("n_rows"))
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return m.select("id", F.col("best.licence").alias("licence"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"), "n_lines")
