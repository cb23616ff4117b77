"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, inherited down directories.

All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.core.durable import cut
from millrace.llm.arrays import ends, given
from millrace.operators.join import apart

#: Licence identifiers with the notices by which files state them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}


def _gnu(what: str, name: str, version: str) -> list[str]:
    stated = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License"
    return [stated, f"{stated}, or (at your option) any later version."]


#: The longer passages by which files and licence texts state a licence, with document frequencies of their own.
PASSAGES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
}
#: A term, and names of licence files.
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
NAMED = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Weights:
    """Inverse document frequencies of the templates' terms, and all that follows from them."""

    def __init__(self, frequencies: dict[str, int], documents: int, least: float, templates: dict[str, list[str]]):
        vocabulary = _vocabulary(templates)
        self.documents = documents
        self.idf = {t: math.log((1 + documents) / (1 + frequencies.get(t, 0))) + 1 for t in vocabulary}
        self.unseen = math.log(1 + documents) + 1
        self.templates = [(f"{name}#{k}", name, self._unit(Counter(terms(x)))) for name, texts in templates.items() for k, x in enumerate(texts)]
        self.keys = sorted({t for _, _, unit in self.templates for t in self._needed(unit, least)})

    def _unit(self, counts: Counter) -> dict[str, float]:
        length = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in counts.items()))
        return {t: n * self.idf[t] / length for t, n in counts.items()}

    def _needed(self, unit: dict[str, float], least: float) -> list[str]:
        """Terms of which a text must have one to come to least: by the others alone its cosine is at most their length."""
        squares = 0.0
        order = sorted(unit, key=lambda t: (self.idf[t], unit[t], t))
        for k, t in enumerate(order):
            squares += unit[t] ** 2
            if math.sqrt(squares) >= least - 1e-9:
                return order[k:]
        return []


def _vocabulary(*templates: dict[str, list[str]]) -> list[str]:
    return sorted({t for kind in templates for texts in kind.values() for x in texts for t in terms(x)})


def weights(files: DataFrame, text_col: str, least: float) -> tuple[Weights, Weights]:
    """Of TEMPLATES and of PASSAGES, by document frequencies over all files of their few hundred terms only."""
    vocabulary = F.array(*(F.lit(t) for t in _vocabulary(TEMPLATES, PASSAGES)))
    seen = files.select(F.explode(F.array_intersect(vocabulary, _terms(F.coalesce(text_col, F.lit(""))))).alias("term"))
    counts = {r.term: r.n for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    return Weights(counts, n, least, TEMPLATES), Weights(counts, n, least, PASSAGES)


#: Most terms of a window of lines: half as many again as the longest template has.
WINDOW = max(len(terms(x)) for kind in (TEMPLATES, PASSAGES) for texts in kind.values() for x in texts) * 3 // 2


def _units(text: Column, pattern: str, whole: Column) -> Column:
    """What of a text is compared, as an array of (first, last, n, terms).

    Each line with a term, of n terms; terms is empty without a match of the pattern. All runs of two or more such lines
    with at most WINDOW terms, one of them in a line of the pattern, and where whole holds all terms at -1: n is null.
    Lines without a term, as empty ones or those of comment marks, don't count; first and last are line numbers.
    """
    lines = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), _terms(x).alias("terms"), x.rlike(pattern).cast("long").alias("key"))), lambda x: F.size(x["terms"]) > 0)
    before = lambda sums, k: F.when(k > 0, F.get(sums, k - 1)).otherwise(0)
    none = F.expr("array()").cast("array<struct<first:int,last:int,n:int,terms:array<string>>>")

    def unit(first: Column, last: Column, n: Column, found: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), n.cast("int").alias("n"), found.alias("terms"))

    def terms_of(own: Column) -> Column:
        return F.flatten(F.transform(own, lambda x: x["terms"]))

    def sums(own: Column) -> Column:
        return F.struct(own.alias("own"), ends(F.transform(own, lambda x: F.size(x["terms"]).cast("long"))).alias("n"), ends(F.transform(own, lambda x: x["key"])).alias("keys"))

    def window(c: Column, k: Column, j: Column) -> Column:
        return unit(F.get(c["own"], k)["i"], F.get(c["own"], j)["i"], F.lit(None), terms_of(F.slice(c["own"], k + 1, j - k + 1)))

    def runs(c: Column) -> Column:
        size = F.size(c["own"])
        held = lambda k, j: (F.get(c["n"], j) - before(c["n"], k) <= WINDOW) & (F.get(c["keys"], j) > before(c["keys"], k))
        ends_of = lambda k: F.filter(F.sequence(k + 1, F.least(k + WINDOW, size - 1)), lambda j: held(k, j))
        return F.flatten(F.transform(F.sequence(F.lit(0), size - 2), lambda k: F.transform(ends_of(k), lambda j: window(c, k, j))))

    def of(own: Column) -> Column:
        single = F.transform(own, lambda x: unit(x["i"], x["i"], F.size(x["terms"]), F.when(x["key"] > 0, x["terms"]).otherwise(F.expr("array()").cast("array<string>"))))
        several = F.when(F.size(own) > 1, given(sums(own), runs)).otherwise(none)
        return F.concat(single, several, F.when(whole, F.array(unit(F.lit(-1), F.lit(-1), F.lit(None), terms_of(own)))).otherwise(none))

    return given(lines, of)


#: What tells the units of a table apart.
UNIT = ["path", "row", "first", "last", "n"]


def _notices(units: DataFrame, kinds: list[Weights], least: float) -> DataFrame:
    """One row of each unit, with best: (by, licence) of the best template, by is the negative score; null if none comes to least.

    Rows of one path and row must lie in one partition; then nothing is shuffled.
    """
    spark = units.sparkSession
    parts: dict[str, list] = {t: [] for w in kinds for t in w.idf}
    for kind, w in enumerate(kinds):
        for key, name, unit in w.templates:
            for t, x in unit.items():
                parts[t].append((kind, key, name, x))
    rows = [(t, [w.idf.get(t, w.unseen) for w in kinds], found) for t, found in parts.items()]
    # one row for each term of a template and so of a fixed size
    table = spark.createDataFrame(rows, "term string, idf array<double>, parts array<struct<kind:int,template:string,licence:string,x:double>>")
    counted = units.select(*UNIT, F.explode_outer("terms").alias("term")).groupBy(*UNIT, "term").agg(F.count("term").alias("tf"))
    weighed = counted.join(F.broadcast(table), "term", "left").withColumn("idf", F.coalesce("idf", F.array(*(F.lit(w.unseen) for w in kinds))))
    y = lambda kind: F.col("tf") * F.get("idf", kind)
    part = lambda kind, template, licence, v: F.struct(kind.alias("kind"), template.alias("template"), licence.alias("licence"), v.alias("v"))
    squares = F.array(*(part(F.lit(k), F.lit(""), F.lit(""), y(F.lit(k)) * y(F.lit(k))) for k in range(len(kinds))))
    products = F.transform("parts", lambda p: part(p["kind"], p["template"], p["licence"], p["x"] * y(p["kind"])))
    summed = weighed.select(*UNIT, F.explode(F.when(F.col("parts").isNull(), squares).otherwise(F.concat(squares, products))).alias("p")).groupBy(*UNIT, "p.kind", "p.template", "p.licence").agg(F.sum("p.v").alias("v"))
    # a text's length by each kind of weights, and its products with at most all templates
    length = F.array(*(F.sqrt(F.max(F.when((F.col("template") == "") & (F.col("kind") == k), F.col("v")))) for k in range(len(kinds))))
    dots = F.collect_list(F.when(F.col("template") != "", F.struct("kind", "template", "licence", "v")))
    by_unit = summed.groupBy(*UNIT).agg(length.alias("length"), dots.alias("dots"))
    scores = F.filter(F.transform("dots", lambda p: F.struct(F.round(p["v"] / F.get("length", p["kind"]), 9).alias("score"), p["template"], p["licence"], p["kind"])), lambda p: p["score"] >= least)
    best = lambda c: [F.array_max(F.filter(c, lambda p: p["kind"] == k)) for k in range(len(kinds))]
    first = lambda c: F.array_min(F.array(*(F.when(x.isNotNull(), F.struct((-x["score"]).alias("by"), x["licence"].alias("licence"))) for x in best(c))))
    return by_unit.select(*UNIT, given(scores, first).alias("best"))


def _best(score: str = "score", licence: str = "licence") -> Column:
    """The licence of the highest score, the first by name of equals."""
    return F.min(F.struct((-F.col(score)).alias("by"), F.col(licence).alias("licence")))


def licences(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.75, share: float = 0.5) -> DataFrame:
    """Find each file's licence: its own header, or that of the nearest directory above with a licence file.

    Returns one row for each distinct path: path_col, licence, score, how and origin. Every line of a file, every run of
    lines with at most WINDOW terms (a notice may be wrapped) and the whole text of a
    file named LICENSE, COPYING, NOTICE or UNLICENSE, is compared with each template by
    the cosine of TF-IDF vectors: those of TEMPLATES, and apart from them those of
    PASSAGES, which full licence texts and longer headers hold. Inverse document frequencies are of the files; a term
    of no template weighs as one that no file has. A file with a line, run or text of score least or more has the
    licence of the best one (how: header). A licence file is one so named, or one of
    whose words share are in such lines or, without such a line, in such runs; it gives its directory its licence, the best
    score of several winning, then the first name. A file without its own gets that of
    its nearest ancestor directory (how: inherited; origin: that directory). Others
    have nulls.

    Paths are split at slashes; a null path is a file outside of all directories with a null path in the
    result. Rows of one path are one file. Null and empty texts have no header. Other
    columns aren't read. An empty table gives an empty result.

    Only lines and runs with a term that some template can't do without are compared; the others
    can't reach least.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    short, long = weights(rows, "text", least)
    keys = sorted({*short.keys, *long.keys})
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in keys) + r")(?![a-z0-9])" if keys else "(?!)"
    key = F.coalesce("path", F.lit("\0")).alias("path")
    named = F.element_at(F.split(F.coalesce("path", F.lit("")), "/", -1), -1).rlike(NAMED)
    texts = rows.where(F.col("text").rlike(pattern)).select(key, F.monotonically_increasing_id().alias("row"), "text", named.alias("whole"))
    # every such text has units; an inner explode would make them a second time, to see whether there are any
    # dealt once by text; up to the sums of each path nothing is shuffled again, and texts never are
    units = texts.select("path", "row", F.explode_outer(_units(F.col("text"), pattern, F.col("whole"))).alias("u")).select("path", "row", "u.*").repartition("path", "row")
    found = _notices(units, [short, long], least).where("best is not null or n is not null")
    # words of lines found by themselves, and of windows without such a line
    held = F.col("best").isNotNull() & (F.col("first") >= 0)
    covered = found.withColumn("one", held & (F.col("first") == F.col("last"))).withColumn("at", F.explode(F.when(held, F.sequence("first", "last")).otherwise(F.array("first"))))
    by_line = covered.withColumn("by_line", F.max("one").over(Window.partitionBy("path", "row", "at")))
    mixed = by_line.withColumn("mixed", F.max("by_line").over(Window.partitionBy("path", "row", "first", "last")))
    by_at = mixed.groupBy("path", "row", "at").agg(F.min("best").alias("best"), F.max("n").alias("n"), F.max(held & (F.col("one") | ~F.col("mixed"))).alias("counted"))
    by_path = by_at.groupBy("path").agg(F.min("best").alias("own"), F.sum(F.when(F.col("counted"), F.col("n"))).alias("n"), F.sum("n").alias("n_terms")).where("own is not null")
    # a row for each path at most, few in most tables: not a file for each partition
    own = cut(by_path, rows=short.documents)

    paths = rows.select(key).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    inside = F.col("path").contains("/")
    files_named = F.element_at(F.split("path", "/", -1), -1).rlike(NAMED)
    stating = own.where(inside & (files_named | (F.col("n") >= share * F.col("n_terms"))))
    stated = stating.select(directory.alias("dir"), (-F.col("own.by")).alias("score"), F.col("own.licence").alias("licence")).groupBy("dir").agg(_best().alias("given"))

    dirs = paths.where(inside).select(directory.alias("dir")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/", -1))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/", -1), F.lit(1), k), "/").alias("up")))
    climbs = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", F.col("a.up").alias("up"))
    nearest = climbs.join(stated.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("given", "up"), "depth").alias("from"))

    out = paths.join(own.select("path", "own"), "path", "left").withColumn("dir", F.when(inside, directory)).join(apart(nearest, "dir"), "dir", "left")
    return out.select(
        F.nullif("path", F.lit("\0")).alias(path_col),
        F.coalesce("own.licence", "from.given.licence").alias("licence"),
        F.coalesce(-F.col("own.by"), -F.col("from.given.by")).alias("score"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("from").isNotNull(), "inherited").alias("how"),
        F.when(F.col("own").isNull(), F.col("from.up")).alias("origin"),
    )
