"""License scans: MinHash bands over overlapping text windows, then exact containment of shingles. DataFrame functions only.

Two window sizes are scanned. Long windows hold 2 * ``STEP`` five-word shingles and begin every ``STEP`` shingles; a
template of more shingles is represented by its pieces of that length at every start, so a window inside an occurrence
equals a piece. A window's band i is the least of its shingles' hashes under the i-th of ``BANDS`` hash functions. With
bands of one row, windows of Jaccard similarity s to a piece share a band with probability 1 - (1 - s)^BANDS. An unbroken
occurrence with four fifths of a template's shingles has a window of s >= 7 / 19 at the worst alignment (10 shingles, two
lost by edits and one cut off), so one in 2 million of the worst is missed. Windows without any shingle of a long template
share no band with a piece, and their bands are not computed. Templates of at most ``STEP`` shingles meet in windows of one
shingle instead, each of which is one of theirs or not, so none is missed. Candidates are then measured exactly, shingle by
shingle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, STEP, BANDS, NUM, DEN = 5, 8, 32, 4, 5
#: Templates are given to every task as constants of the plan; more than these shingles are refused.
MAX_TEMPLATE_SHINGLES = 20_000

# Names and wording of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "Zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "Warranty-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
}


def shingles_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 0))] or ([" ".join(words)] if words else [])


def _hash(shingle: Column) -> Column:
    """Of a shingle's words the hash of their hashes."""
    words = F.split(shingle, " ")
    return F.xxhash64(*[F.xxhash64(words[k]) for k in range(SHINGLE)])


def _bands(hashes: Column) -> Column:
    """The least of the hashes under each of ``BANDS`` hash functions."""
    return F.array(*[F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))) for k in range(BANDS)])


def template_bands(docs: DataFrame, templates: dict[str, str]) -> tuple[list[int], list[int], dict[str, list[int]]]:
    """Shingle hashes of the short templates, those of the long ones, and for each long one the bands of its pieces."""
    short, long, pieces = [], [], []
    for name, text in templates.items():
        own = shingles_of(text)
        (short if len(own) <= STEP else long).append((name, own))
        if len(own) > STEP:
            pieces += [(name, own[i : i + 2 * STEP]) for i in range(max(len(own) - 2 * STEP + 1, 1))]
    spark = docs.sparkSession

    def values(lists: list[tuple[str, list[str]]], of: Callable[[Column], Column]) -> list[tuple[str, int]]:
        if not lists:
            return []
        table = spark.createDataFrame(lists, "name string, s array<string>").select("name", F.transform("s", _hash).alias("h"))
        return sorted((r["name"], r.v) for r in table.select("name", F.explode(of(F.col("h"))).alias("v")).distinct().collect())

    bands: dict[str, list[int]] = {}
    for name, v in values(pieces, _bands):
        bands.setdefault(name, []).append(v)
    plain = lambda found: sorted({v for _, v in found})
    return plain(values(short, lambda h: h)), plain(values(long, lambda h: h)), bands


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, template, n_shared, n_shingles, containment.

    Words are runs of ASCII letters and digits with A-Z in lower case. A document's regions for a template of n shingles
    have 2 n shingles and begin every n; n_shared is the most of the template's distinct shingles in one region, and the
    template is found if that is at least four fifths of them. Null and empty texts, and texts of fewer than five words,
    have no shingles and no rows. Repeated rows are reported each. An empty table gives an empty result; other columns
    are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(shingles_of(t)) for t in templates.values()) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many template shingles for constants of a plan; scan with several smaller sets")
    singles, parts, bands = template_bands(docs, templates)
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)).alias("words")).where(F.size("words") >= SHINGLE)
    hashed = words.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size("wh") - SHINGLE)
    hashed = hashed.withColumn("h", F.transform(starts, lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(SHINGLE)])))

    def places_of(values: list[int]) -> Column:
        if not values:
            return F.array().cast("array<int>")
        return F.filter(F.transform("h", lambda h, i: F.when(h.isin(values), i)), lambda i: i.isNotNull())

    by_one = places_of(singles)
    # the windows that hold such a shingle: the one of its block and the one before
    near = F.filter(F.array_distinct(F.flatten(F.transform(places_of(parts), lambda i: F.array(F.floor(i / STEP) - 1, F.floor(i / STEP))))), lambda j: j >= 0)
    # of each such window the bands that some template has; those tell which templates are measured there
    known = sorted({v for own in bands.values() for v in own})
    met = F.transform(near, lambda j: F.struct(j.cast("long").alias("j"), F.filter(_bands(F.slice("h", (j * STEP + 1).cast("int"), F.lit(2 * STEP))), lambda v: v.isin(known)).alias("bands")))
    by_many = F.filter(met, lambda x: F.size(x["bands"]) > 0) if bands else F.array().cast("array<struct<j:bigint,bands:array<bigint>>>")
    # a generator, not a filter: a filter would be pushed below and evaluate everything it refers to anew
    hits = F.filter(F.array(F.struct(by_one.alias("one"), by_many.alias("many"))), lambda x: (F.size(x["one"]) > 0) | (F.size(x["many"]) > 0))
    found = hashed.select("doc_id", "words", F.explode(hits).alias("hits")).select("doc_id", "words", "hits.*")
    shingled = found.withColumn("s", F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.array_join(F.slice("words", i + 1, F.lit(SHINGLE)), " ")))
    def measure(name: str, own: list[str], at: Column) -> Column:
        n, constants = len(own), F.array(*map(F.lit, own))
        regions = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / n), F.greatest(F.floor(i / n) - 1, F.lit(0))))))
        shared = F.array_max(F.transform(regions, lambda r: F.size(F.array_intersect(F.slice("s", (r * n + 1).cast("int"), F.lit(2 * n)), constants))))
        return F.struct(F.lit(name).alias("template"), F.coalesce(shared, F.lit(0)).cast("long").alias("n_shared"), F.lit(n).cast("long").alias("n_shingles"))

    def places(name: str) -> Column:
        retrieved = F.filter("many", lambda x: F.arrays_overlap(x["bands"], F.array(*map(F.lit, bands[name]))))
        return F.flatten(F.transform(retrieved, lambda x: F.sequence(x["j"] * STEP, x["j"] * STEP + 2 * STEP - 1)))

    measured = [measure(name, sorted(set(shingles_of(text))), F.col("one") if len(shingles_of(text)) <= STEP else places(name)) for name, text in templates.items()]
    out = shingled.select("doc_id", F.explode(F.filter(F.array(*measured), lambda m: m["n_shared"] * DEN >= m["n_shingles"] * NUM)).alias("m"))
    return out.select("doc_id", "m.*", F.round(F.col("m.n_shared") / F.col("m.n_shingles"), 6).alias("containment"))
