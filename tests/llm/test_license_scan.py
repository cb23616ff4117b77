import math
from collections import Counter, defaultdict
from pathlib import Path

from millrace.core.durable import ensure_checkpoint_dir
from millrace.llm import license_scan as ls

FIELDS = "path string, text string, licence int, dir string"


def brute(rows, least=0.75, share=0.5):
    docs = [t or "" for _, t, *_ in rows]
    vocabulary = {t for texts in ls.TEMPLATES.values() for x in texts for t in ls.terms(x)}
    df = Counter(t for d in docs for t in set(ls.terms(d)) & vocabulary)
    idf = defaultdict(lambda: math.log(1 + len(docs)) + 1, {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary})
    vector = lambda text: {t: n * idf[t] for t, n in Counter(ls.terms(text)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(x)) for name, texts in ls.TEMPLATES.items() for x in texts]

    def best(text):
        v = vector(text)
        scores = [(round(sum(v.get(t, 0) * x for t, x in u.items()) / length(v) / length(u), 9), name) for name, u in templates] if v else []
        top = max((s for s, _ in scores), default=0)
        return (-top, max(name for s, name in scores if s == top)) if top >= least else None

    files = defaultdict(list)
    for path, text, *_ in rows:
        files[path].append(text or "")
    own, stated = {}, defaultdict(list)
    for path, texts in files.items():
        name = (path or "").rsplit("/", 1)[-1]
        named = bool(__import__("re").match(ls.NAMED, name))
        lines = [(best(x), len(ls.terms(x))) for t in texts for x in t.split("\n")]
        found = [b for b, _ in lines if b] + [b for t in texts if named and (b := best(t))]
        if found:
            own[path] = min(found)
            words = sum(n for b, n in lines if b)
            if path and "/" in path and (named or words >= share * sum(len(ls.terms(t)) for t in texts)):
                stated[path.rsplit("/", 1)[0]].append(own[path])
    out = []
    for path in files:
        if path in own:
            out.append((path, own[path][1], -own[path][0], "header", None))
            continue
        up = path.rsplit("/", 1)[0] if path and "/" in path else None
        while up is not None and up not in stated:
            up = up.rsplit("/", 1)[0] if "/" in up else None
        given = min(stated[up]) if up is not None else None
        out.append((path, given and given[1], given and -given[0], given and "inherited", given and up))
    return sorted(out, key=str)


def test_licences_are_those_of_brute_force(spark):
    text = "some prose of no interest to anyone\n"
    rows = [
        ("a/LICENSE", "MIT License\n\n" + ls.TEMPLATES["MIT"][3] + "."),
        ("a/x.py", text), ("a/b/c/y.py", text * 20), ("a/b/LICENSE.txt", ls.TEMPLATES["Apache-2.0"][0]), ("a/b/own.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + text),
        ("a/b/note", "licensed under cc by-nc 4.0\n"), ("q/r/s.txt", text), ("q/z", None), ("q/z2", ""), (None, text + "Released under the MIT License."), (None, text),
        ("top", "Licensed under the Apache License, Version 2.0."), ("/abs/dir/f", text + "This work is licensed under the GNU General Public License, version 3."), ("/abs/dir/g", text),
        ("/abs/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/x.py", text), ("a/b/far", "the version of the work is under license to the public " * 3),
    ]
    rows = [(p, t, 1, "clash") for p, t in rows] + [(f"bulk/{i % 7}/{i}", text * (i % 5), 2, None) for i in range(60)]
    found = ls.licences(spark.createDataFrame(rows, FIELDS).repartition(3))
    got = sorted(((r.path, r.licence, r.score, r.how, r.origin) for r in found.collect()), key=str)
    want = brute(rows)
    assert [(*r[:2], r[2] and round(r[2], 6), *r[3:]) for r in got] == [(*r[:2], r[2] and round(r[2], 6), *r[3:]) for r in want]
    assert {r[3] for r in got} == {"header", "inherited", None}


MIT = """Copyright (c) 2019 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """# Copyright 2020 The Authors. All rights reserved.
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met
import os
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""


def test_wrapped_notices_and_full_texts_are_found(spark):
    text = "some prose of no interest to anyone\n"
    rows = [("/s/a/1", MIT), ("/s/b/2", text * 5 + MIT + text), ("/s/c/3", BSD), ("/s/d/4", text + "this is\nReleased under\n\n// the MIT\n// License.\n" + text), ("/s/e/5", "int x;\n" + GPL2), ("/s/f/LICENSE", MIT), ("/s/f/6", text), ("/s/g/7", text * 3)]
    rows += [(f"bulk/{i}", text * 3) for i in range(60)]
    found = {r.path: (r.licence, r.how) for r in ls.licences(spark.createDataFrame([(*r, 1, "clash") for r in rows], FIELDS)).collect()}
    want = {"1": "MIT", "2": "MIT", "3": "BSD-3-Clause", "4": "MIT", "5": "GPL-2.0", "LICENSE": "MIT"}
    assert {p.rsplit("/", 1)[1]: f for p, f in found.items() if f[1] == "header"} == {k: (v, "header") for k, v in want.items()}
    assert found["/s/f/6"] == ("MIT", "inherited") and found["/s/g/7"] == (None, None) and len(found) == len(rows)


def test_empty_table(spark):
    assert ls.licences(spark.createDataFrame([], FIELDS)).collect() == []


def test_checkpoints_are_few_files_for_a_table_in_many_parts(spark):
    text = "some prose of no interest to anyone\n"
    rows = [(f"/s/{i % 3}/{i}", text + ("Released under the MIT License." if i % 2 else ""), 1, "clash") for i in range(80)]
    table = spark.createDataFrame(rows, FIELDS).repartition(40)
    ensure_checkpoint_dir(spark)
    written = lambda: set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))
    before = written()
    found = {r.path: r.licence for r in ls.licences(table).collect()}
    assert found == {p: "MIT" if int(p.rsplit("/", 1)[1]) % 2 else None for p in found} and len(found) == 80
    assert len(written() - before) <= 2
