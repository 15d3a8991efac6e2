"""Licence scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are lower-cased runs of letters and digits, in shingles of five words. Templates
of n shingles belong to the class m, the least power of two of at least 1.25 n; texts are cut into
windows of 2 m shingles that begin every m, so that an occurrence of a template lies whole in one of
them. Windows and templates that share one of ``BANDS`` MinHash values are candidates; a candidate
matches if the window holds at least 80 % of the template's shingles.

A window that holds 80 % of n shingles of which n / 2.5 <= m has a Jaccard similarity of at least
0.32 m / 2.08 m = 0.15, so 48 bands of one row find it with probability 1 - 0.85^48 > 0.999; exact
occurrences in their class's window reach 0.2 and 0.99997.

Only windows with an anchor word are hashed. The anchors of a template are words that stand in over
20 % of its shingles, so that what holds 80 % of them holds an anchor: nothing is lost.

Defined results: a null or empty text has no match; repeated rows of one doc_id are one document; a
text that holds a template several times gives one row, with the best window, the first on ties; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINED = 5, 48, 0.8
#: Characters of templates, times BANDS, up to which their table is broadcast.
SENT = 50_000_000

# Notices as licences ask for them or as they are commonly written.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every template has some in over 20 % of its shingles; long words first, as prose has few of them."""
    chosen: set[str] = set()
    for text in templates.values():
        own = _plain(text)
        grams = [own[i : i + SHINGLE] for i in range(len(own) - SHINGLE + 1)]
        for word in sorted(set(own), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(any(w in chosen for w in g) for g in grams) > (1 - CONTAINED) * len(grams):
                break
            chosen.add(word)
    return sorted(chosen)


def klass(n: int) -> int:
    m = 1
    while m < 1.25 * n:
        m *= 2
    return m


def shingles(words_: Column, first: Column, last: Column) -> Column:
    """Hashes of the shingles from ``first`` to before ``last``, counted from 0."""
    return F.when(last > first, F.transform(F.sequence(first, last - 1), lambda i: F.xxhash64(F.array_join(F.slice(words_, i + 1, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def signature(hashes: Column) -> Column:
    """The MinHash value of each band."""

    def value(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(k), h)))

    return F.array(*(value(k) for k in range(BANDS)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word, words): the best window of each document and template that match."""
    templates = TEMPLATES if templates is None else templates
    if short := [k for k, v in templates.items() if len(_plain(v)) < SHINGLE]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    spark, marks = docs.sparkSession, anchors(templates)
    table = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    n = F.size("w") - (SHINGLE - 1)
    table = table.select("license", n.alias("n"), shingles(F.col("w"), F.lit(0), n).alias("own"))
    table = table.select("license", "own", F.size(F.array_distinct("own")).alias("n"), F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(1.25 * F.col("n"))))).cast("int").alias("m"))
    sizes = sorted({klass(len(_plain(v)) - SHINGLE + 1) for v in templates.values()})
    table = table.select("license", "own", "n", "m", F.posexplode(signature(F.col("own"))).alias("band", "value"))
    table = F.broadcast(table) if BANDS * sum(map(len, templates.values())) <= SENT else table  # BANDS rows a template, each with its shingles

    low = F.lower("text")
    some = F.lit(False)
    for a in marks:
        some = some | F.contains(low, F.lit(a))
    rows = docs.select("doc_id", "text").filter(some).select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("total", F.size("w") - (SHINGLE - 1)).filter("total > 0")
    hits = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at("w", i + 1).isin(marks))
    near = lambda m: F.array_distinct(
        F.flatten(F.transform(hits, lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.floor((p - (SHINGLE - 1)) / m).cast("int") - 1), F.floor(p / m).cast("int")), lambda j: F.struct(F.lit(m).alias("m"), (j * m).alias("first")))))
    )
    rows = rows.withColumn("window", F.explode(F.concat(*(near(m) for m in sizes)))).filter("window.first < total")
    last = F.least(F.col("total"), F.col("window.first") + 2 * F.col("window.m"))
    rows = rows.select("doc_id", F.col("window.m").alias("m"), F.col("window.first").alias("first_word"), shingles(F.col("w"), F.col("window.first"), last).alias("have"))
    rows = rows.select("*", F.posexplode(signature(F.col("have"))).alias("band", "value"))
    pairs = rows.join(table, ["m", "band", "value"])
    share = F.size(F.array_intersect("have", "own")) / F.col("n")
    found = pairs.select("doc_id", "license", share.alias("containment"), F.col("first_word").cast("long"), F.size("have").cast("long").alias("size")).filter(F.col("containment") >= CONTAINED)
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", -F.col("first_word"), "size")).alias("b"))
    return best.select("doc_id", "license", "b.containment", (-F.col("b.col2")).alias("first_word"), (F.col("b.size") + SHINGLE - 1).alias("words"))
