"""Licence scans: TF-IDF cosine of licence statements to templates, and inheritance from the nearest directory.

Statements are the sentences and paragraphs of a text that a licence word starts off; nothing else of the text is
shuffled. Their weights come from all statements of the corpus, as joins on terms; the templates are a small table, of
which those count that name the same version and the same variant of their family. A directory has the licence of its licence files, and a file without a statement of its own takes that of its nearest
ancestor directory, by a join on paths.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_text

#: What licence headers and files say. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
]
LEAST_COSINE = 0.6
#: How far a statement's licence is ahead of the next one that its words agree with.
MARGIN = 0.02
#: Words that part licences of one family; a statement and its template have the same ones. Fixed values.
_MARKS = {
    "affero": r"affero|agpl", "lesser": r"lesser general|library general|lgpl", "noncommercial": r"non-?commercial|by-nc", "sharealike": r"share-?alike|(?:by|nc)-sa", "noderivatives": r"no-?deriv|(?:by|nc)-nd",
    "clause2": r"2-clause|simplified bsd|freebsd licen", "clause3": r"3-clause|neither the name|(?:new|modified|revised) bsd",
}
_VERSION = re.compile(r"(?:version|\bv\.?|licen[sc]e,?|attribution(?:-[a-z]+)*|\bby(?:-[a-z]+)*|cc0)[\s,-]*v?\.?\s*(\d+(?:\.\d+)?)")
_DENIED = re.compile(r"\b(?:not|never|no longer)\s+(?:\w+\s+){0,2}?(?:licensed|released|covered|available|under|subject)\b|n't\s+(?:\w+\s+){0,2}?(?:licensed|released|covered|available|under|subject)\b")
#: A list of conditions goes on over such paragraphs.
_LIST = re.compile(rb"[\x20\x09*#/;-]*(?:\(?[0-9a-z][.)]|\*|-|\xe2\x80\xa2)[\x20\x09]")
#: Names of licence files.
_FILE = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[._-].*)?$"
#: SPDX headers name the licence: an identifier, or several joined by OR, AND and WITH; the first counts, as of a tie.
_SPDX = re.compile(rb"(?i)spdx-license-identifier:[\x20\x09(]*([a-z0-9][a-z0-9.+-]*)")
_CUE = re.compile(rb"(?i)licen[sc]|spdx|permission is hereby granted|permission to use, copy|redistribution and use|public domain")
_STOP = re.compile(rb"(?<=[.!?])[\x20\x09-\x0d]+|\n+")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def statements(text: bytes) -> list[bytes]:
    """Sentences with a licence cue, and paragraphs (lines without an empty one between) that say more, with the list of conditions that follows."""
    if not _CUE.search(text):
        return []
    out, blocks = [], re.split(rb"\n[\x20\x09\x0d]*\n", text)
    for k, block in enumerate(blocks):
        if _CUE.search(block):
            end = k + 1
            if b"following conditions" in block:
                while end < len(blocks) and _LIST.match(blocks[end]):
                    end += 1
            whole = b"\n\n".join(blocks[k:end])
            mine = [s for s in _STOP.split(block) if _CUE.search(s)]
            out += mine
            if mine != [whole]:
                out.append(whole)
    return out


def facts(statement: str) -> tuple[str | None, list[str], bool]:
    """The version that a statement names first (without .0), the words that part licences of one family, and whether it denies the licence."""
    low = statement.lower()
    named = _VERSION.search(low)
    return named and re.sub(r"\.0$", "", named[1]), sorted(m for m, p in _MARKS.items() if re.search(p, low)), bool(_DENIED.search(low))


def spdx_license(statement: bytes) -> str | None:
    """The first licence of an SPDX header as the templates name it (without -only, -or-later, +), others as they stand."""
    m = _SPDX.search(statement)
    if not m:
        return None
    said = re.sub(r"(?i)(?:-only|-or-later|\+)$", "", m.group(1).decode().rstrip("."))
    return {name.lower(): name for name, _ in TEMPLATES}.get(said.lower(), said)


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def own_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "__row", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """(id_col, license, cosine) of the rows whose best statement reaches `least`; id_col tells rows apart.

    A statement with an SPDX header has the licence that this names, at cosine 1, whether a template has it or not. Of other
    statements those count that do not deny a licence; a template counts for them if it has the same family words, and the same
    version if it has one. A statement that two licences fit within MARGIN has none.

    templates: (license, text). Ties of the cosine between statements go to the first licence by name.
    """
    text, array = T.StringType(), T.ArrayType(T.StringType())
    kinds = [T.StructField("version", text), T.StructField("marks", array), T.StructField("denied", T.BooleanType())]

    def make():
        def run(texts):
            rows, out = [], []
            for r, t in enumerate(texts):
                for k, s in enumerate(statements(t or b"")):
                    said = s.decode("utf-8", "replace")
                    rows.append(r)
                    out.append((k, said, spdx_license(s), *facts(said)))
            return rows, list(zip(*out)) if out else [[]] * 6

        return run

    def make_facts():
        return lambda texts: list(zip(*[facts(t.decode()) for t in texts])) or [[]] * 3

    said = map_text(docs, make, [T.StructField("k", T.IntegerType()), T.StructField("said", text), T.StructField("spdx", text), *kinds], [id_col], text_col, explode=True)
    said = checkpoint(said.where("spdx IS NOT NULL OR NOT denied").withColumn("unit", F.struct(F.col(id_col), F.col("k"), F.col("version"), F.col("marks"))))
    known = map_text(templates.where("text IS NOT NULL"), make_facts, kinds, ["license", "text"])
    models = known.select(F.struct(F.col("license"), F.xxhash64("text").alias("n"), F.col("version"), F.col("marks")).alias("model"), "text")
    tf, model_tf = _terms(said, "unit", "said"), _terms(models, "model", "text")
    df = tf.select("term").unionByName(model_tf.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = said.count() + templates.count()
    idf = df.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weigh = lambda x, key: x.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    unit_w, model_w = checkpoint(weigh(tf, "unit")), weigh(model_tf, "model")
    norm = unit_w.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    model_norm = model_w.groupBy("model").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("model_norm"))
    dot = unit_w.join(model_w.withColumnRenamed("w", "v"), "term").groupBy("unit", "model").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    agree = (F.col("unit.marks") == F.col("model.marks")) & (F.col("model.version").isNull() | F.col("model.version").eqNullSafe(F.col("unit.version")))
    cosine = dot.where(agree).join(norm, "unit").join(model_norm, "model").select("unit", "model.license", F.round(F.col("dot") / F.col("norm") / F.col("model_norm"), 9).alias("cosine")).where(F.col("cosine") >= least)
    by_license = cosine.groupBy("unit", "license").agg(F.max("cosine").alias("cosine"))
    ranked = by_license.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "license"))).alias("r"))  # one entry a licence
    clear = ranked.where((F.size("r") == 1) | (F.get("r", F.lit(1))["c"] - F.get("r", F.lit(0))["c"] >= MARGIN)).select("unit", F.get("r", F.lit(0))["license"].alias("license"), (-F.get("r", F.lit(0))["c"]).alias("cosine"))
    named = said.where("spdx is not null")
    both = clear.join(named.select("unit"), "unit", "left_anti").unionByName(named.select("unit", F.col("spdx").alias("license"), F.lit(1.0).alias("cosine")))
    best = both.groupBy(F.col(f"unit.{id_col}").alias(id_col)).agg(F.min_by(F.struct("license", "cosine"), F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    return best.select(id_col, "best.license", "best.cosine")


def scan(docs: DataFrame, templates: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, path, license, cosine, origin, directory) for each row of docs.

    origin is `own`, `inherited` (directory then names the ancestor) or null where neither holds. Licence files are known by
    their names (_FILE). A directory that holds several has the licence of the largest cosine, the first path on ties, the
    first licence by name within a file. Very long texts are read whole, an empty table gives an empty one. Null and empty texts have no
    statement; a null path inherits nothing. Rows are told apart by id and path: of rows that repeat both, all get the
    best licence of any. Other columns are left out.
    """
    docs = docs.select(F.col(id_col), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("__t"))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col), F.col("path")))
    own = checkpoint(own_licenses(keyed, templates, "__row", "__t"))
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = own.select(F.col("__row.path").alias("path"), "license", "cosine").where("path is not null").where(name.rlike(_FILE))
    by_folder = files.groupBy(folder.alias("folder")).agg(F.min_by("license", F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("folder_license"))
    folders = keyed.where("path is not null").select(folder.alias("of")).distinct()
    parts = F.split("of", "/")
    above = folders.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))).alias("x")).select("of", "x.depth", "x.folder")
    near = checkpoint(above.join(by_folder, "folder").groupBy("of").agg(F.max_by(F.struct("folder", "folder_license"), F.col("depth")).alias("near")))  # apart from the join below, whose large folders can then be split
    told = keyed.select(id_col, "path", folder.alias("of")).join(own.select(F.col(f"__row.{id_col}").alias("__id"), F.col("__row.path").alias("__path"), "license", "cosine"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    out = told.join(near, "of", "left")
    return out.select(id_col, "path", F.coalesce("license", "near.folder_license").alias("license"), "cosine", F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("origin"), F.when(F.col("license").isNull(), F.col("near.folder")).alias("directory"))


def standard_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")
