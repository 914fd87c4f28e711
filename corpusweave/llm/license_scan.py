"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then directory inheritance.

DataFrame functions only. The templates' terms and their inverse document frequencies make sparse template
vectors of unit length. A text is scored line by line, by runs of adjacent lines, as notices are wrapped, and whole.
A run is as long as the longest template at most, but for the rest of its last line; comment signs are no terms, and
lines without terms don't end a run. A line can reach the threshold only if it holds one of the template's heavy
terms: the terms outside that set are together shorter than the threshold. More sharply, a cosine is at most the length of the template's
vector on the terms that both share, and terms of no template only add to the part's length. Parts for which that is below the threshold with every template are left out
before their terms are exploded, which changes no result; so are runs whose first or last line has no term of any
template, as they score less without it. The rest is one join of terms with template entries
and two sums.

A file without a licence of its own takes that of the nearest directory above it which has a licence file:
directories are joined with the licence directories along their ancestor paths, files with their directory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.7

# Notices by which licences are commonly named, and titles of their files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work: CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
]

#: How templates begin that stand in other licences too: a notice of theirs counts where no other one is found. The later of
#: these says more than the earlier.
GENERAL = ("Redistribution and use in source and binary forms", "Redistributions in binary form must reproduce")

# Fixed value: a term is a run of letters and digits, with dots inside numbers.
TERM = r"[0-9]+(?:\.[0-9]+)*|[a-z]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_vectors(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Entries of the unit template vectors: ``template``, ``license``, ``term``, ``idf``, ``weight``, ``heavy``."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, body string")
    tf = rows.select("template", "license", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").withColumn("idf", _idf(F.col("df"), len(templates)))
    raw = raw.withColumn("raw", F.col("count") * F.col("idf"))
    of = Window.partitionBy("template")
    unit = raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of)))
    # Light terms, taken from the lightest on, are together shorter than the threshold.
    rising = of.orderBy("weight", "term").rowsBetween(Window.unboundedPreceding, 0)
    light = F.sum(F.col("weight") * F.col("weight")).over(rising)
    return unit.select("template", "license", "term", "idf", "weight", (light >= threshold * threshold * 0.999).alias("heavy"))


def _idf(df: Column, n: int) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1


def _reaches(found: Column, table: list, threshold: float) -> Column:
    """Whether some template is, on the terms in ``found``, as long as the threshold."""
    squares: dict[int, list] = {}
    for r in table:
        squares.setdefault(r.template, []).append((r.term, r.weight * r.weight))
    rows = [
        F.struct(F.array(*[F.lit(t) for t, _ in of]).alias("terms"), F.array(*[F.lit(s) for _, s in of]).alias("squares"))
        for of in squares.values()
    ]
    # The margin is for rounding. The outer exists makes ``found`` a variable, which is worked out once.
    long_enough = lambda d, t: F.aggregate(
        F.zip_with(t["terms"], t["squares"], lambda term, s: F.when(F.array_contains(d, term), s).otherwise(0.0)),
        F.lit(0.0),
        lambda a, s: a + s,
    ) >= F.lit(threshold * threshold * 0.999)
    return F.exists(F.array(found), lambda d: F.exists(F.array(*rows), lambda t: long_enough(d, t)))


def _close(w: Column, known: Column, table: list, unknown: float, threshold: float) -> Column:
    """Whether some cosine of the terms ``w`` can reach the threshold: exact, but that no unknown term is repeated."""
    by: dict[int, list] = {}
    for r in table:
        by.setdefault(r.template, []).append(r)
    rows = [F.struct(F.array(*[F.lit(r.term) for r in of]).alias("terms"), F.array(*[F.lit(r.weight) for r in of]).alias("weights")) for of in by.values()]
    idf = F.create_map(*[F.lit(x) for pair in sorted({r.term: r.idf for r in table}.items()) for x in pair])
    add = lambda a, x: a + x
    size = lambda d: F.transform(d, lambda t: (F.size(w) - F.size(F.array_remove(w, t))) * F.element_at(idf, t))
    least = lambda m: F.sqrt(
        F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x * x) + F.size(F.array_except(w, known)) * F.lit(unknown * unknown)
    )
    dot = lambda m, t: F.aggregate(
        F.zip_with(t["terms"], t["weights"], lambda term, x: x * F.coalesce(F.element_at(m, term), F.lit(0.0))), F.lit(0.0), add
    )
    # Exists over one element makes a variable, which is worked out once.
    reached = lambda m: F.exists(
        F.array(least(m)), lambda n: F.exists(F.array(*rows), lambda t: dot(m, t) >= n * F.lit(threshold * 0.999))
    )
    return F.exists(F.array(F.array_intersect(w, known)), lambda d: F.exists(F.array(F.map_from_arrays(d, size(d))), reached))


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The best licence per path: ``path``, ``license``, ``score``, ``line`` (from 1; of a run the first; 0: the whole text).

    Paths without a notice of at least ``threshold`` are absent. Notices of ``GENERAL`` templates come behind all others. Ties
    go to the earliest line, then to the name. Of several texts with one path each is scored by itself, and the best counts.
    """
    spark = files.sparkSession
    entries = template_vectors(spark, templates, threshold)
    # The templates are a parameter of the driver program, so what follows is as small as they are.
    table = entries.collect()
    heavy = sorted({r.term for r in table if r.heavy})
    unknown = float(spark.range(1).select(_idf(F.lit(0.0), len(templates))).first()[0])
    any_heavy = "(?<![0-9a-z])(?:" + "|".join(t.replace(".", "\\.") for t in heavy) + ")(?![0-9a-z])"
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    some = files.select(F.col(path_col).alias("path"), text.alias("t")).filter(F.col("t").rlike(any_heavy))
    some = some.withColumn("own", F.sha2("t", 256))  # a path may have several texts
    known, heavy = F.array(*[F.lit(t) for t in sorted({r.term for r in table})]), F.array(*[F.lit(t) for t in heavy])
    longest = max(len(re.findall(TERM, body.lower())) for _, body in templates)
    reaches = lambda w: _reaches(F.array_intersect(w, known), table, threshold)
    # Explodes of one element, so that terms are worked out once. No part reaches what the text doesn't.
    some = some.select("path", "own", "t", F.explode(F.array(terms(F.col("t")))).alias("all")).filter(reaches(F.col("all")))
    lines = F.filter(
        F.transform(F.split("t", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), terms(x).alias("w"))),
        lambda s: F.size(s["w"]) > 0,
    )
    some = some.select("path", "own", "all", F.explode(F.array(lines)).alias("lines"))
    part = lambda line, upto, w: F.struct(line.alias("line"), upto.alias("upto"), w.alias("w"))
    singles = F.transform(F.filter("lines", lambda s: F.arrays_overlap(s["w"], heavy)), lambda s: part(s["line"], F.size(s["w"]), s["w"]))
    # From each line on: the terms of the longest run, and where its lines end, each as a run's end.
    longer = lambda a, s: F.when(F.size(a["w"]) >= longest, a).otherwise(
        F.struct(
            F.concat(a["w"], s["w"]).alias("w"),
            F.when(F.arrays_overlap(s["w"], known), F.concat(a["ends"], F.array(F.size(a["w"]) + F.size(s["w"])))).otherwise(a["ends"]).alias("ends"),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("w"), F.array().cast("array<int>").alias("ends"))
    windows = F.transform(
        F.filter(F.transform("lines", lambda s, i: F.struct(i.alias("i"), s["line"].alias("line"), s["w"].alias("w"))), lambda s: F.arrays_overlap(s["w"], known)),
        lambda s: F.struct(s["line"].alias("line"), F.aggregate(F.slice("lines", s["i"] + 1, F.lit(longest)), start, longer).alias("run")),
    )
    windows = F.filter(windows, lambda x: (F.size(x["run"]["ends"]) > 1) & F.arrays_overlap(x["run"]["w"], heavy))
    windows = F.filter(windows, lambda x: reaches(x["run"]["w"]))
    runs = F.flatten(
        F.transform(
            windows,
            lambda x: F.transform(
                F.slice(x["run"]["ends"], F.lit(2), F.size(x["run"]["ends"])),
                lambda e: part(x["line"], e, F.slice(x["run"]["w"], F.lit(1), e)),
            ),
        )
    )
    whole = F.array(part(F.lit(0), F.lit(0), F.col("all")))
    near = some.select("path", "own", F.inline(F.concat(whole, singles, runs))).filter(reaches(F.col("w")))
    near = near.filter(_close(F.col("w"), known, table, unknown, threshold))
    of = ["path", "own", "line", "upto"]
    parts = near.select(*of, F.explode("w").alias("term"))
    tf = parts.groupBy(*of, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = spark.createDataFrame(
        [(t, {r.term: r.idf for r in table}[t], [(r.template, r.license, r.weight) for r in table if r.term == t]) for t in sorted({r.term for r in table})],
        "term string, idf double, entries array<struct<template:int,license:string,weight:double>>",
    )
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # One pass for the norm and all dot products: a part has one row per template that it shares a term with.
    none = F.array(F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("weight")))
    dots = weighed.select(
        *of, "w", F.explode(F.when(F.col("entries").isNull(), none).otherwise(F.concat("entries", none))).alias("e")
    )
    dots = dots.groupBy(*of, "e.template", "e.license").agg(
        F.sum(F.col("w") * F.col("e.weight")).alias("dot"),
        F.sum(F.when(F.col("e.template") == -1, F.col("w") * F.col("w"))).alias("square"),
    )
    per_line = dots.groupBy(*of).agg(
        F.max("square").alias("square"),
        F.min(F.when(F.col("template") >= 0, F.struct((-F.col("dot")).alias("d"), "license", "template"))).alias("best"),
    )
    general = lambda body: next((len(GENERAL) - k for k, g in enumerate(GENERAL) if body.startswith(g)), 0)
    ranks = [general(body) for _, body in templates]
    rank = F.element_at(F.array(*map(F.lit, ranks)), F.col("best.template") + 1)
    scored = per_line.select(
        "path", "line", F.col("best.license").alias("license"), F.round(-F.col("best.d") / F.sqrt("square"), 6).alias("score"), rank.alias("rank")
    ).filter(F.col("score") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "line", "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line"))


def inherit(files: DataFrame, own: DataFrame, path_col: str = "path", licence_file: str = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$") -> DataFrame:
    """Licences with inheritance: ``path``, ``license``, ``score``, ``line``, ``origin`` (own, inherited or null),
    ``from_path`` (the file that holds the notice).

    A path is split at ``/``. Of several licence files in a directory the first by name counts. Null paths have none.
    """
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    here = own.select("path", "license", "score", "line", folder(F.col("path")).alias("dir"))
    holders = (
        here.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(licence_file))
        .groupBy("dir")
        .agg(F.min(F.struct("path", "license", "score", "line")).alias("held"))
    )
    paths = files.select(F.col(path_col).alias("path"), folder(F.col(path_col)).alias("dir"))
    steps = F.split("dir", "/")
    above = (
        paths.select("dir")
        .filter("dir is not null")
        .distinct()
        .select(
            "dir",
            F.posexplode(
                F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
            ).alias("depth", "up"),
        )
    )
    nearest = (
        above.join(holders.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", F.col("held.path").alias("from_path"), "held")).alias("near"))
        .select(F.col("dir").alias("of"), F.col("near.held").alias("held"))
    )
    mine = here.select(F.col("path").alias("p"), F.col("license").alias("l"), F.col("score").alias("s"), F.col("line").alias("n"))
    out = paths.join(mine, F.col("path") == F.col("p"), "left").join(nearest, F.col("dir") == F.col("of"), "left")
    has = F.col("p").isNotNull()
    return out.select(
        "path",
        F.when(has, F.col("l")).otherwise(F.col("held.license")).alias("license"),
        F.when(has, F.col("s")).otherwise(F.col("held.score")).alias("score"),
        F.when(has, F.col("n")).otherwise(F.col("held.line")).alias("line"),
        F.when(has, F.lit("own")).when(F.col("held").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("held.path")).alias("from_path"),
    )


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Scan and inheritance for a table of files; one row per row of ``files``.

    * Null and empty texts have no notice; a null path gets a row without licence.
    * Repeated paths: each of their texts is scored by itself, and each of their rows gets the best notice among them.
    * Ties: see :func:`scan`. An empty table gives an empty result; further columns are ignored.
    """
    return inherit(files, scan(files.filter(F.col(path_col).isNotNull()), path_col, text_col, templates, threshold), path_col)
