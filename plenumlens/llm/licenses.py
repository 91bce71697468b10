"""License scans: MinHash bands over overlapping windows, then exact containment.

A document's words are cut into windows that overlap by half and are at least twice as long as a
template, so that every place of a template lies in one. Windows and templates that agree in one
band of their MinHash signatures are compared exactly: a template is found where a window holds
enough of its shingles, among them those with the words that tell its license from others.

A band's value is a shingle of the window. A window without any shingle of a template can
therefore agree with no template, and its signature isn't computed. Everything is built-in
column functions; the signatures of the templates are a literal table of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.functions.base import compute_once
from plenumlens.llm.jaccard import text_keys

SHINGLE = 5
CONTAINED = 0.8
#: A template that is contained that much meets its window in a band, but for one case in a million.
MISS = 1e-6
#: Windows step by a power of two of words, this at least.
LEAST_STEP = 8

#: Notices by which licenses are told (fixed values). A clause that licenses share stands under the one without further ones.
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-2-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words that tell a license from those of like wording: a template of it that has them is found only with them.
TELLING = {
    "agpl-3.0": ["affero", "version 3"],
    "apache-2.0": ["version 2 0"],
    "cc-by-4.0": ["attribution 4 0"],
    "cc-by-nc-4.0": ["by nc 4 0"],
    "cc-by-sa-4.0": ["sharealike 4 0"],
    "epl-2.0": ["license 2 0"],
    "gpl-2.0": ["gnu general public license", "version 2"],
    "gpl-3.0": ["gnu general public license", "version 3"],
    "lgpl-2.1": ["lesser", "version 2 1"],
    "lgpl-3.0": ["lesser", "version 3"],
    "mpl-2.0": ["v 2 0"],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of letters a-z and digits, after lower-casing A-Z; a null text has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda w: w != "")


def shingles(word: Column) -> Column:
    """All shingles of an array of words, in order; fewer words have none."""
    return F.transform(F.when(F.size(word) >= SHINGLE, F.sequence(F.lit(1), F.size(word) - SHINGLE + 1)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.array_join(F.slice(word, i, SHINGLE), " "))


def _step(n: int) -> int:
    return max(LEAST_STEP, 1 << math.ceil(math.log2(max(n, 1))))


def bands_for(templates: list[int]) -> int:
    """Bands (of one row) so that a contained template of these numbers of words is missed with ``MISS`` at most."""
    worst = min((CONTAINED * (n - SHINGLE + 1) / (2 * _step(n) - SHINGLE + 1 + 0.2 * (n - SHINGLE + 1)) for n in templates), default=1.0)
    return math.ceil(math.log(MISS) / math.log(1 - min(worst, 0.999)))


def signature(shingle: Column, bands: int) -> Column:
    """Band keys of a set of shingles: per band, the least of its hashes, with the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(shingle, lambda s: F.xxhash64(s, j)))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """Rows (template, license, shingles, step) of templates with a shingle at least."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("notice"))
                               for i, (name, text) in enumerate(templates)]))
    known = spark.range(1).select(rows.alias("t")).select("t.template", "t.license", words(F.col("t.notice")).alias("w"))
    least = F.greatest(F.lit(float(LEAST_STEP)), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("w").cast("double"))))).cast("int")
    return known.select("template", "license", F.array_distinct(shingles(F.col("w"))).alias("wanted"), F.size("w").alias("n"), least.alias("step")).where("size(wanted) > 0")


def telling_shingles(wanted: list[str], phrases: list[str]) -> list[list[str]]:
    """Per phrase that the shingles hold, those with it: a text must have one of each list."""
    found = [[s for s in wanted if f" {phrase} " in f" {s} "] for phrase in phrases]
    return [some for some in found if some]


def license_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
                    telling: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (key, k1, k2, license, template, first_word, containment): windows that contain a template.

    One row per window and template; ``first_word`` is the window's first word (from 0). A template
    of a license with ``telling`` phrases (five words at most each, in lower case) that stand in it
    is found only where the window holds a template shingle with each. Null and empty texts and an
    empty table give no rows, repeated rows give theirs once, and templates shorter than a shingle
    are passed over.
    """
    spark = docs.sparkSession
    chosen = TEMPLATES if templates is None else templates
    known = template_table(spark, chosen).collect() if chosen else []  # the templates given, no data
    wanted = sorted({s for t in known for s in t["wanted"]})
    heads = sorted({s.split(" ")[0] for s in wanted})
    steps = sorted({t["step"] for t in known})
    if not known:
        empty = docs.select(docs[key].alias("key"), *text_keys(text)).where(F.lit(False))
        return empty.select(F.col("key").alias(key), "k1", "k2", F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment"))
    bands = bands_for([t["n"] for t in known])
    plain = docs.select(docs[key].alias("key"), *text_keys(text), docs[text].alias("text"))
    rows = compute_once(plain, ["key", "k1", "k2"], "w", words(F.col("text")))
    at_head = F.filter(F.transform("w", lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull())
    hits = F.filter(at_head, lambda i: F.array_join(F.slice(F.col("w"), i + 1, SHINGLE), " ").isin(wanted))
    # the windows over each hit: the one that begins at or before it, and the one before that
    def over(step: int, back: int) -> Column:
        return F.transform("hits", lambda i: F.struct(F.lit(step).alias("step"), (F.floor(i / step) - back).cast("int").alias("window")))

    windows = F.array_distinct(F.flatten(F.array(*[over(step, back) for step in steps for back in (0, 1)])))
    cut = (compute_once(rows, ["key", "k1", "k2", "w"], "hits", hits).where(F.size("hits") > 0)
           .select("key", "k1", "k2", "w", F.explode(windows).alias("at")).where("at.window >= 0")
           .select("key", "k1", "k2", "at.step", (F.col("at.window") * F.col("at.step")).alias("first_word"),
                   F.array_distinct(shingles(F.slice("w", F.col("at.window") * F.col("at.step") + 1, F.col("at.step") * 2))).alias("held")))
    signed = cut.where("size(held) > 0").withColumn("band", F.explode(signature(F.col("held"), bands)))
    notices = template_table(spark, chosen)
    bank = notices.select("template", "license", "wanted", F.col("step").alias("t_step"), F.explode(signature(F.col("wanted"), bands)).alias("t_band"))
    met = (signed.join(F.broadcast(bank), (F.col("band") == F.col("t_band")) & (F.col("step") == F.col("t_step")))  # templates x bands rows
           .groupBy("key", "k1", "k2", "template", "license", "step", "first_word")
           .agg(F.first("held").alias("held"), F.first("wanted").alias("wanted")))
    contained = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    told = F.lit(True)
    for t in known:
        for some in telling_shingles(t["wanted"], (TELLING if telling is None else telling).get(t["license"], [])):
            told = told & ((F.col("template") != t["template"]) | F.arrays_overlap("held", F.array(*map(F.lit, some))))
    return (met.withColumn("containment", contained).where((F.col("containment") >= CONTAINED) & told)
            .select(F.col("key").alias(key), "k1", "k2", "license", "template", "first_word", "containment"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
         telling: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: key, n_licenses, licenses (sorted, comma-joined; empty: none) and the best containment (0: none).

    Null and empty texts hold no license, templates shorter than a shingle are passed over,
    rows with null or equal keys stay separate rows, and an empty table gives an empty result.
    Other columns are left out.
    """
    found = license_matches(docs, key, text, templates, telling).groupBy(F.col(key).alias("f"), F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(
        F.array_sort(F.collect_set("license")).alias("names"), F.max("containment").alias("best"))
    rows = docs.select(docs[key].alias("key"), *text_keys(text))
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("f")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    return joined.select(F.col("key").alias(key), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
                         F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))
