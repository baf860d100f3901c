"""Secret and licence scans: places by brute force, verdicts on what the documents hold, inheritance by hand."""

import re

import pytest
from pyspark.sql import functions as F

from rastermill.llm import entry, licenses, secretscan


@pytest.fixture(scope="module")
def model(spark):
    return secretscan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_secrets_of_documents(spark, model):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = entry.op8_secret_scan(spark, d).collect()
    by = {}
    for r in rows:
        t = texts[r.doc_id]
        by.setdefault(r.doc_id, {})[(r.start, r.end)] = r.secret
        assert re.fullmatch("[A-Za-z0-9+/_=-]{12,}", t[r.start : r.end]) and 0 <= r.score <= 1
    planted = [(i, m.span(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"|', t or "") if m.group(1)]
    planted += [(i, m.span(1)) for i, t in texts.items() for m in re.finditer(r"(?:password=)([0-9a-f]{16,})", t or "")]
    planted += [(i, m.span()) for i, t in texts.items() for m in re.finditer(r"\bAKIA[0-9A-Z]{16}\b", t or "")]
    assert planted and sum(by[i][s] for i, s in planted) >= 0.95 * len(planted)
    wrong = [r for r in rows if r.secret and (r.doc_id, (r.start, r.end)) not in planted]
    assert len(wrong) <= 0.05 * len(planted)


def test_secrets_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, 'é token = "0123456789abcdef0123456789abcdef01234567" x'), (3, 'é token = "0123456789abcdef0123456789abcdef01234567" x'), (4, "word " * 30000), (5, "a1" * 40000), (None, "x" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit("clash"))
    got = secretscan.scan(df, model, ["doc_id", "score"])
    assert sorted((r.doc_id, r.start, r.end, r.secret) for r in got.where("doc_id < 5").collect()) == [(3, 11, 51, True)] * 2
    assert [(r.start, r.end) for r in got.where("doc_id = 5").collect()] == [(0, 80000)]
    assert secretscan.scan(df.limit(0), model, ["doc_id"]).count() == 0
    assert secretscan.fit(df.limit(0)).trees == []


def test_reviewed_findings_train_the_forest(spark):
    docs = spark.createDataFrame([(i, f"{'key' if i % 2 else 'sum'}: {'%032x' % (i * 7919 ** 7 % (1 << 128))} end", "src") for i in range(200)], "doc_id long, text string, source string")
    findings = docs.select("doc_id", F.lit(5).cast("long").alias("start"), F.lit(37).cast("long").alias("end"), (F.col("doc_id") % 2).alias("secret"))
    model = secretscan.fit(docs, findings)
    assert len(model.trees) == secretscan.TREES
    assert secretscan.fit(docs, findings.limit(0)).trees == []


def test_licences_of_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = {"Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
    rows = entry.op5_license_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        mine = {v for k, v in said.items() if k in texts[r.doc_id]}
        assert (r.origin == "own") == bool(mine) and (not mine or r.license in mine)


MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def test_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/x.txt", "plain words"), (3, "a/b/c/COPYING", GPL), (4, "a/b/c/d/y.txt", None), (5, "a/b/c/z.txt", f"{'words ' * 200}\n{MIT}"), (6, "other/x.txt", ""), (7, None, "no path"),
        (8, None, MIT), (9, "top.txt", "nothing"), (10, "a/b/c/COPYING2", "license unclear"), (2, "a/b/x.txt", "plain words"), (None, "a/q.txt", "x"), (11, "ab/x.txt", "words"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = [(r.doc_id, r.license, r.origin, r.directory) for r in licenses.scan(df, licenses.standard_templates(spark)).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "GPL-3.0", "own", None), (4, "GPL-3.0", "inherited", "a/b/c"), (5, "MIT", "own", None), (6, None, None, None), (7, None, None, None),
        (8, "MIT", "own", None), (9, None, None, None), (10, "GPL-3.0", "inherited", "a/b/c"), (None, "MIT", "inherited", "a"), (11, None, None, None),
    ], key=repr)
    assert licenses.scan(df.limit(0), licenses.standard_templates(spark)).count() == 0


def test_spdx_headers_inside_another_licence(spark):
    said = {"Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "(LGPL-2.1-only WITH x)": "LGPL-2.1", "Zlib": "Zlib"}
    rows = [(0, "a/LICENSE", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")]
    rows += [(k, f"a/{k}.py", f"# SPDX-License-Identifier: {s}\n" + "code words\n" * 50) for k, s in enumerate(said, 1)]
    rows += [(20, "a/20", "Released under the ISC License."), (21, "a/21", "This is free and unencumbered software released into the public domain."), (22, "a/22", "This work is licensed under the GNU Affero General Public License, version 3."), (23, "a/23", "Licensed under the BSD 2-Clause License.")]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), licenses.standard_templates(spark)).collect()}
    assert got == {0: ("MPL-2.0", "own"), **{k: (v, "own") for k, v in enumerate(said.values(), 1)}, 20: ("ISC", "own"), 21: ("Unlicense", "own"), 22: ("AGPL-3.0", "own"), 23: ("BSD-2-Clause", "own")}


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
LICENCES = {
    "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.": "GPL-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    BSD: "BSD-2-Clause",
    f"Copyright (c) 2020\n\n{BSD}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED AS IS": "BSD-3-Clause",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This file is not licensed under the Apache License, Version 2.0.": None,
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": "GPL-2.0",
    "MIT License\n\nCopyright (c) 2021\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:": "MIT",
    "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.": "Apache-2.0",
    "This code isn't released under the MIT License.": None,
    "The committee will license the stadium to two clubs.": None,
}


def test_versions_clauses_and_denials(spark):
    df = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(LICENCES)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.standard_templates(spark)).collect()}
    assert got == dict(enumerate(LICENCES.values()))


def test_rare_and_bare_secrets(spark, model):
    plain = [(i, f"build {i * 7919:012d} commit {i * 104729 ** 3 % (1 << 128):032x} end") for i in range(5000)]
    bare = [(9000, "see AKIA" + "Q7" * 8 + " here"), (9001, "see ghp_" + "a1B2" * 9 + " here")]
    few = [(9002, 'token = "0123456789abcdef0123456789abcdef01234567"')]
    df = spark.createDataFrame([*plain, *bare, *few], "doc_id long, text string").withColumn("source", F.lit("s"))
    own = secretscan.fit(df)
    assert len(own.trees) == secretscan.TREES and own.cut < float("inf")
    assert {r.doc_id for r in secretscan.scan(df, own, ["doc_id"]).where("secret").collect()} == {9000, 9001, 9002}
    assert {9000, 9001} <= {r.doc_id for r in secretscan.scan(df, model, ["doc_id"]).where("secret").collect()}
    lone = df.where("doc_id < 5000 OR doc_id = 9002")
    by_rule = secretscan.fit(lone)
    assert by_rule.cut == float("inf") and [r.doc_id for r in secretscan.scan(lone, by_rule, ["doc_id"]).where("secret").collect()] == [9002]


def test_a_reviewed_finding_past_the_fiftieth(spark):
    text = " ".join(f"{k:016x}" for k in range(80))
    docs = spark.createDataFrame([(i, text, "s") for i in range(40)], "doc_id long, text string, source string")
    findings = docs.select("doc_id", F.lit(60 * 17).cast("long").alias("start"), F.lit(60 * 17 + 16).cast("long").alias("end"), (F.col("doc_id") % 2).alias("secret"))
    assert len(secretscan.fit(docs, findings).trees) == secretscan.TREES


def test_the_forest_counts_all_rows(spark):
    import numpy as np

    from rastermill.llm import trees

    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=9000), rng.integers(0, 2, 9000), rng.integers(0, 300, 9000), np.zeros(9000)], axis=1)
    y = ((x[:, 0] > 0.3) & (x[:, 1] == 1) | (rng.random(9000) < 0.05)).astype(float)
    h = rng.integers(-(1 << 63), 1 << 63, 9000)
    rows = spark.createDataFrame([(int(a), float(b), c.tolist()) for a, b, c in zip(h, y, x)], "h long, y double, x array<double>")
    made, again = (trees.forest(r, 6, 4) for r in (rows, rows.repartition(7)))
    weight = trees.bag(h, 6)
    assert abs(weight.mean() - 1) < 0.02 and abs((weight == 0).mean() - np.exp(-1)) < 0.02
    for k, (t, u) in enumerate(zip(made, again)):
        assert (t.feature == u.feature).all() and (t.cut == u.cut).all() and (t.value == u.value).all()
        todo = [(0, np.ones(9000, bool))]
        while todo:
            at, here = todo.pop()
            w = weight[here, k]
            assert abs(t.value[at] - w @ y[here] / w.sum()) < 1e-12
            if t.feature[at] >= 0:
                low = here & (x[:, t.feature[at]] < t.cut[at])
                assert w.sum() > weight[low, k].sum() >= trees.LEAST
                todo += [(t.left[at], low), (t.left[at] + 1, here & ~low)]
    s = trees.out_of_bag(made, h, x)
    assert np.allclose(np.nan_to_num(s), np.nan_to_num([np.mean([t.predict(v[None])[0] for t, o in zip(made, w) if not o] or [np.nan]) for v, w in zip(x, weight)]))
    there = ~np.isnan(s)
    for precision in (0.2, 0.9, 0.99, 2.0):
        scored = spark.createDataFrame(list(zip(s[there].tolist(), y[there].tolist())), "s double, y double")
        assert trees.precise_cut_of(scored, precision) == trees.precise_cut(s[there], y[there], precision, halfway=True)
    assert trees.forest(rows.limit(0), 6, 4) == [] and trees.precise_cut_of(scored.limit(0), 0.5) == float("inf")


def test_secrets_are_learnt_from_all_documents(spark):
    word = lambda i: "zq" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [(i, f"{word(i)} build {i * 7919:012d} commit {i * 104729 ** 3 % (1 << 128):032x}" + f" key = {i:016x}" * (i % 100 == 7)) for i in range(9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("source", F.lit("s"))
    model = secretscan.fit(docs, dictionary=20000)
    assert {word(i).encode() for i in range(9000)} <= model.words
    base = docs.selectExpr("doc_id AS __id", "source AS __path", "text AS __t")
    assert secretscan.labelled(base, model).count() == sum(len(secretscan.candidates(t.encode())) for _, t in texts)
    other = secretscan.fit(docs.repartition(5), dictionary=20000)
    assert other.cut == model.cut and all((a.cut == b.cut).all() and (a.value == b.value).all() for a, b in zip(model.trees, other.trees))


def test_scores_by_walking_each_tree(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = secretscan.scan(docs, model, ["doc_id"]).collect()
    assert len(rows) == sum(len(secretscan.candidates((t or "").encode())) for t, _ in texts.values())
    for r in rows[::5]:
        t, path = texts[r.doc_id]
        a = len(t[: r.start].encode())
        x = model.features(t.encode(), a, a + r.end - r.start, path)
        leaves = []
        for tree in model.trees:
            at = 0
            while tree.feature[at] >= 0:
                at = tree.left[at] + (0 if x[tree.feature[at]] < tree.cut[at] else 1)
            leaves.append(tree.value[at])
        assert abs(r.score - sum(leaves) / len(leaves)) < 1e-9


def licences_by_hand(docs):
    """(doc_id, licence, cosine) by plain TF-IDF over all statements."""
    import math
    from collections import Counter

    terms = lambda s: Counter(re.findall(licenses.TERM, s.lower()))
    units = [(i, s.decode("utf-8", "replace"), licenses.spdx_license(s)) for i, t in docs for s in licenses.statements((t or "").encode())]
    df = Counter(w for _, s, _ in units for w in terms(s)) + Counter(w for _, s in licenses.TEMPLATES for w in terms(s))
    n = len(units) + len(licenses.TEMPLATES)
    weights = lambda s: {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in terms(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    models, best = [(name, weights(s), licenses.facts(s)) for name, s in licenses.TEMPLATES], {}
    for i, s, spdx in units:
        v, (version, marks, denied) = weights(s), licenses.facts(s)
        top = {}
        for name, m, (number, kind, _) in models if not spdx and not denied else []:
            c = round(sum(x * m.get(w, 0) for w, x in v.items()) / norm(v) / norm(m), 9)
            if kind == marks and number in (None, version) and c >= licenses.LEAST_COSINE:
                top[name] = max(c, top.get(name, 0))
        ranked = [(1.0, spdx)] if spdx else sorted(((c, name) for name, c in top.items()), key=lambda x: (-x[0], x[1]))
        if ranked and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= licenses.MARGIN):
            c, name = ranked[0]
            if i not in best or (-c, name) < (-best[i][0], best[i][1]):
                best[i] = (c, name)
    return best


def test_licences_equal_plain_tf_idf(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = licences_by_hand(docs)
    rows = entry.op5_license_scan(spark, d).collect()
    folders = {(r.path.rsplit("/", 1)[0]): r.license for r in rows if r.path.endswith("/LICENSE") and r.origin == "own"}
    assert folders
    for r in rows:
        if r.origin != "own":
            above = [f for f in folders if r.path.startswith(f + "/")]
            assert (r.license, r.origin, r.directory) == ((folders[above[0]], "inherited", above[0]) if above else (None, None, None))
    assert any(r.origin == "inherited" for r in rows)
    assert {r.doc_id: (round(r.cosine, 6), r.license) for r in rows if r.origin == "own"} == {i: (round(c, 6), name) for i, (c, name) in want.items()}


def test_licence_ties_and_long_texts(spark):
    both = "SPDX-License-Identifier: MIT\n\nSPDX-License-Identifier: Apache-2.0"
    rows = [(1, "a/COPYING", MIT), (2, "a/LICENSE", GPL), (3, "a/x", ""), (4, "b/y", both), (5, "c/LICENSES.md", MIT), (6, "c/x", ""), (7, "d/z", "word " * 400000 + "\n\n" + MIT)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), licenses.standard_templates(spark)).collect()}
    assert got[3] == ("MIT", "inherited") and got[4] == ("Apache-2.0", "own") and got[6] == (None, None) and got[7] == ("MIT", "own")
