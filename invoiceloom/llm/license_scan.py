"""Licence notices and texts found by the Dice coefficient over word bigrams. Built-in functions only, no shuffle.

Every line of a text, and the text as a whole, is normalised and compared with the templates whose number of bigrams is near enough:
``2 |A & B| / (|A| + |B|) >= t`` needs ``t |A| <= (2 - t) |B|`` and the other way round, so most templates are never looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.rows import ascii_lower, packed, unpacked

THRESHOLD_PERCENT = 75
WHOLE_TEXT = -1

# Wording of licence notices and of the paragraphs that grant rights, as their publishers give them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: ASCII that is neither letter nor digit stands between words; all other characters belong to them.
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(BETWEEN_WORDS, " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words_of(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(ascii_lower(text), BETWEEN_WORDS, " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.array_distinct(pairs)


def scan(
    df: DataFrame,
    text_column: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold_percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """``df`` with ``license_matches``: (line, license, dice) of each line, or of the whole text (line -1), that is like a template.

    A text of one line is compared as that line only. Null and empty texts, and lines of fewer than two words, match nothing. Several templates may match one
    line; the matches come by line and then by template. Rows stay one to one, also repeated ones; a column called ``license_matches`` is replaced.
    """
    told = [(name, template_bigrams(text)) for name, text in (TEMPLATES if templates is None else templates)]
    told = [(name, grams) for name, grams in told if grams]
    if not told:
        raise ValueError("no template has a bigram")
    t = threshold_percent
    literal = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("size"), F.array(*[F.lit(x) for x in g]).alias("grams")) for n, g in told]
    )
    fewest = min(t * len(g) / (200 - t) for _, g in told)
    match_type = "array<struct<line: int, license: string, dice: double>>"

    def compared(grams: Column, line: Column) -> Column:
        near = F.filter(
            literal, lambda x: (t * F.size(grams) <= (200 - t) * x["size"]) & (t * x["size"] <= (200 - t) * F.size(grams))
        )
        scored = F.transform(
            near,
            lambda x: F.struct(
                line.cast("int").alias("line"), x["name"].alias("license"),
                (F.lit(2.0) * F.size(F.array_intersect(grams, x["grams"])) / (F.size(grams) + x["size"])).alias("dice"),
            ),
        )
        return F.filter(scored, lambda m: 100 * m["dice"] >= t)

    def unit(text: Column, line: Column) -> Column:
        """Words are counted first: fewer than the smallest template allows can't match, and their bigrams aren't made."""
        by_words = F.transform(
            F.array(words_of(text)),
            lambda w: F.when(
                F.size(w) - 1 >= F.lit(fewest),
                F.get(F.transform(F.array(bigrams_of(w)), lambda g: compared(g, line)), 0),
            ).otherwise(F.array().cast(match_type)),
        )
        return F.get(by_words, 0)

    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    rows = df.select(packed(df)).withColumn("body", text).withColumn("lines", F.split("body", "\n", -1))
    by_line = F.flatten(F.transform("lines", lambda line, i: unit(line, i)))
    whole = F.when(F.size("lines") > 1, unit(F.col("body"), F.lit(WHOLE_TEXT))).otherwise(F.array().cast(match_type))
    return unpacked(rows, df.columns, {"license_matches": F.concat(whole, by_line)})


def passages(
    df: DataFrame,
    text_column: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold_percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """``df`` with ``license_passages``: (word, n_words, license, dice) of each run of words, across lines, that is like a template.

    Runs hold at most ``(2 - t) / t`` times the template's bigrams, repeated ones counted each time. They begin and end with a bigram of the template: a
    longer run around the same shared bigrams has no higher coefficient. Each first bigram takes its best end, the nearest of equals; of runs of one
    template that overlap the best is kept, the first of equals. Texts that share too few bigrams with a template aren't searched for it. Rows stay
    one to one; a column called ``license_passages`` is replaced.
    """
    told = [(name, template_bigrams(text)) for name, text in (TEMPLATES if templates is None else templates)]
    told = [(name, grams) for name, grams in told if grams]
    if not told:
        raise ValueError("no template has a bigram")
    t = threshold_percent
    strings = lambda grams: F.array(*[F.lit(x) for x in grams])
    literal = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(len(g)).alias("size"), strings(g).alias("grams"),
                F.lit(-(-t * len(g) // (200 - t))).alias("least"), F.lit((200 - t) * len(g) // t).alias("most"),
            )
            for n, g in told
        ]
    )
    every = strings(sorted({x for _, g in told for x in g}))
    fewest = min(-(-t * len(g) // (200 - t)) for _, g in told)
    run_type = "array<struct<word: int, n_words: int, license: string, dice: double>>"
    none = F.array().cast(run_type)
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def run(pairs: Column, first: Column, last: Column, x: Column) -> Column:
        own = F.array_distinct(F.slice(pairs, first + 1, last - first + 1))
        dice = let(own, lambda a: F.lit(2.0) * F.size(F.array_intersect(a, x["grams"])) / (F.size(a) + x["size"]))
        return F.struct((-dice).alias("worse"), (last - first + 2).alias("n_words"))

    def best_from(pairs: Column, hits: Column, i: Column, x: Column) -> Column:
        first = F.get(hits, i)
        ends = F.filter(F.slice(hits, i + x["least"], x["most"]), lambda p: p < first + x["most"])
        best = F.array_min(F.transform(ends, lambda last: run(pairs, first, last, x)))
        return let(best, lambda b: F.struct(first.alias("word"), b["n_words"].alias("n_words"), x["name"].alias("license"), (-b["worse"]).alias("dice")))

    def of_template(pairs: Column, hits: Column, x: Column) -> Column:
        found = F.filter(F.transform(hits, lambda _, i: best_from(pairs, hits, i, x)), lambda m: 100 * m["dice"] >= t)

        def add(kept: Column, m: Column) -> Column:
            last = F.get(kept, F.size(kept) - 1)
            apart = (F.size(kept) == 0) | (m["word"] >= last["word"] + last["n_words"])
            better = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(m))
            return F.when(apart, F.concat(kept, F.array(m))).when(m["dice"] > last["dice"], better).otherwise(kept)

        return F.aggregate(found.cast(run_type), none, add)

    def search(pairs: Column) -> Column:
        positions = lambda x: F.filter(
            F.transform(pairs, lambda g, i: F.when(F.array_contains(x["grams"], g), i)), lambda i: i.isNotNull()
        )
        shared = F.array_intersect(pairs, every)
        near = let(shared, lambda s: F.filter(literal, lambda x: F.size(F.array_intersect(s, x["grams"])) >= x["least"]))
        return F.flatten(F.transform(near, lambda x: let(positions(x), lambda hits: of_template(pairs, hits, x))))

    def pairs_of(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))

    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    rows = df.select(packed(df)).withColumn("body", text)
    found = let(words_of(F.col("body")), lambda w: F.when(F.size(w) - 1 >= F.lit(max(fewest, 1)), let(pairs_of(w), search)).otherwise(none))
    return unpacked(rows, df.columns, {"license_passages": F.array_sort(found)})
