"""License scans: sparse TF-IDF cosine of licence notices to templates, then inheritance from the nearest directory.

Method: blocks of a text that name a licence become sparse vectors of word counts times inverse document frequency, and
are compared with the templates' vectors by cosine. Blocks are lines, a line with its neighbours, sentences, paragraphs
and the whole text. A template counts for a block only if the deciding words agree: the version, the family's name, the
SPDX id, and what sets apart the kinds of a family (Affero, Lesser, NC, SA, ND). A file's own licence is its best template
if the cosine reaches ``cut``. A licence file speaks for its directory; a file without a licence of its own takes that of
the nearest directory above it that has one, found by joining the file's ancestor paths to those directories.

Frequencies count the files of the whole table that have a licence line, by the words of those lines, for the words of
the templates (a bounded vocabulary); any other word has frequency zero, so it weighs most and pulls the cosine down.

DataFrame functions only: no Python runs on the executors.

Defined cases: null and empty texts and paths have no licence; a null path inherits nothing; ties go to the
template whose name comes first, and among licence files of one directory to the greatest cosine, then the least
licence name; repeated rows are files of their own with equal results; empty tables give empty results; other
columns are never read. An SPDX expression of several ids gives no licence, nor does a notice without a version where
the templates of that family have one.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, materialize, text_key

#: Names and usual notices of common licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
#: (SPDX id, name, version, date of the GNU licences or none).
_NAMED = [
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"), ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"), ("Apache-2.0", "Apache License", "2.0", ""),
    ("MPL-1.1", "Mozilla Public License", "1.1", ""), ("MPL-2.0", "Mozilla Public License", "2.0", ""), ("EPL-1.0", "Eclipse Public License", "1.0", ""),
    ("EPL-2.0", "Eclipse Public License", "2.0", ""), ("BSL-1.0", "Boost Software License", "1.0", ""), ("MIT", "MIT License", "", ""),
    ("ISC", "ISC License", "", ""), ("BSD-2-Clause", "BSD 2-Clause License", "", ""), ("BSD-3-Clause", "BSD 3-Clause License", "", ""),
]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]


def more_templates() -> list[tuple[str, str]]:
    """Titles, notices and SPDX lines of further licences and versions, and of those of ``TEMPLATES`` in other words."""
    out = [("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("CC0-1.0", "CC0 1.0 Universal"), ("MIT", _MIT), ("ISC", _ISC),
           ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0 Universal")]
    for spdx, name, version, date in _NAMED:
        at = f", version {version}" if version else ""
        out += [(spdx, name + at), (spdx, f"Licensed under the {name}{at}"), (spdx, f"Released under the {name}{at}"), (spdx, f"This work is licensed under the {name}{at}")]
        short = spdx.split("-")[0]
        if version:
            out += [(spdx, f"Licensed under the {short} {version}"), (spdx, f"Released under the {short} version {version}"), (spdx, f"{short} {version} License")]
        if date:
            out += [(spdx, f"{name} Version {version}, {date}"), (spdx, _GNU.format(name, version)), (spdx, f"Licensed under the GNU {short}, version {version}")]
    for kind, name in _CC:
        for version in ("3.0", "4.0"):
            where = "International" if version == "4.0" else "Unported"
            out += [(f"CC-{kind}-{version}", f"{verb} {x}") for verb in ("Licensed under", "This work is licensed under a") for x in (
                f"CC {kind} {version}", f"Creative Commons {name} {version} {where} License")]
    ids = {name for name, _ in [*TEMPLATES, *out]}
    out += [(x, f"SPDX-License-Identifier: {x}") for x in sorted(ids)]
    return sorted(set(out) - set(TEMPLATES))


MORE_TEMPLATES = more_templates()
#: A block that is scored holds one of these.
MARKERS = r"(?i)licen[cs]|copyright|spdx|permission is hereby|redistribut|public domain"
#: What a template says, the block must say, too.
FAMILIES = {"apache": "apache", "mit": r"\bmit\b", "bsd": r"\bbsd", "isc": r"\bisc\b", "gnu": r"\bgnu|gpl", "mozilla": r"\bmozilla|\bmpl", "cc": r"\bcc\b|creative commons",
            "cc0": r"\bcc0", "eclipse": r"\beclipse|\bepl", "boost": r"\bboost|\bbsl"}
#: Block and template both say these, or neither does.
KINDS = {"affero": r"affero|\bagpl", "lesser": r"\blesser\b|\blgpl|library general public", "nc": r"\bnc\b|non-? ?commercial", "sa": r"\bsa\b|share-? ?alike",
         "nd": r"\bnd\b|no-? ?deriv", "many": r"spdx-license-identifier: *[^ \n]+ +(or|and|with)\b|spdx-license-identifier: *\("}
VERSION = r"(?<![0-9.])([0-9](?:\.[0-9])?)(?![0-9]|\.[0-9])"
SPDX = r"spdx-license-identifier: *([a-z0-9.-]+?)(?:-only|-or-later|\+)?(?![a-z0-9.+-])"
WORD = "[a-z0-9]+"
CUT = 0.6


def literal_rows(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A table of constants as one literal of the plan (lists handed over from Python would be read by Python on the executors)."""
    names = [x.split()[0] for x in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl.replace(' ', ':').replace(',:', ',')}>>")))


def line_words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def deciding_words(text: str) -> tuple[str, str]:
    """(what a block must hold, kinds that must be equal) of a template, blank-separated."""
    low = text.lower()
    held = [k for k, p in FAMILIES.items() if re.search(p, low)] + [v if "." in v else v + ".0" for v in re.findall(VERSION, low)]
    return " ".join(held), " ".join([k for k, p in KINDS.items() if re.search(p, low)] + re.findall(SPDX, low))


def deciding(block: Column) -> tuple[Column, Column]:
    """The same of a block."""
    low = F.lower(block)
    named = [F.when(low.rlike(p), F.lit(k)) for k, p in FAMILIES.items()]
    versions = F.transform(F.regexp_extract_all(low, F.lit(VERSION), F.lit(1)), lambda v: F.when(v.contains("."), v).otherwise(F.concat(v, F.lit(".0"))))
    kinds = [F.when(low.rlike(p), F.lit(k)) for k, p in KINDS.items()]
    return (F.array_join(F.concat(F.array(*named), F.array_distinct(versions)), " "),
            F.array_join(F.concat(F.array(*kinds), F.regexp_extract_all(low, F.lit(SPDX), F.lit(1))), " "))


def blocks(files: DataFrame) -> DataFrame:
    """(did, h, block, line, x): the blocks of each file that are scored; ``line``: it is a line of the text."""
    marked = files.filter(F.col("text").rlike(MARKERS)).select("did", "h", "text", F.split("text", r"\r?\n").alias("ls"))
    marked = marked.select("did", "h", "text", "ls", F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get("ls", i).rlike(MARKERS)).alias("at"),
                           F.filter(F.split("text", r"\r?\n[^A-Za-z0-9\n]*\n"), lambda x: x.rlike(MARKERS)).alias("paragraphs"))
    near = [(-1, 0), (0, 1), (-1, 1)]
    around = F.flatten(F.transform("at", lambda i: F.array(*[F.concat_ws(" ", *[F.when(i + k >= 0, F.get("ls", i + k)) for k in range(a, b + 1)]) for a, b in near])))
    sentences = F.filter(F.flatten(F.transform("paragraphs", lambda p: F.split(p, r"(?<=[.!?])\s+"))), lambda x: x.rlike(MARKERS))
    lines = marked.select("did", "h", F.array_distinct(F.transform("at", lambda i: F.get("ls", i))).alias("lines"),
                          F.concat(around, sentences, "paragraphs", F.array("text")).alias("others"))
    lines = lines.select("did", "h", F.size("lines").alias("n"), F.concat("lines", F.array_except("others", "lines")).alias("all"))
    # outer: the planner would test an inner generator's input first, splitting the text anew for each line
    both = lines.select("did", "h", "n", F.posexplode_outer("all").alias("block", "x"))
    return both.select("did", "h", "block", (F.col("block") < F.col("n")).alias("line"), "x")


def own_licenses(files: DataFrame, cut: float) -> DataFrame:
    """(did, h, license, score) of files whose best template reaches ``cut``. ``files``: (did, h, text)."""
    spark = files.sparkSession
    every = [(i, name, text, *deciding_words(text)) for i, (name, text) in enumerate([*TEMPLATES, *MORE_TEMPLATES])]
    terms = [(t, name, held, kinds, w) for t, name, text, held, kinds in every for w in re.findall(WORD, text.lower())]
    of_template = [(*x, terms.count(x)) for x in sorted(set(terms))]
    vocabulary = sorted({x[4] for x in of_template})  # of fixed size

    held, kinds = deciding(F.col("x"))
    # beside the generator these would be worked out once for each word
    known_by = blocks(files).select("did", "h", "block", "line", held.alias("held"), kinds.alias("kinds"), line_words(F.col("x")).alias("words"))
    words = known_by.select("did", "h", "block", "line", "held", "kinds", F.explode_outer("words").alias("term")).filter("term is not null")
    # rows that repeat an id and its text would double all counts of their blocks; the cosine stays the same
    counts = materialize(words.groupBy("did", "h", "block", "line", "held", "kinds", "term").agg(F.count(F.lit(1)).alias("n")), "terms")
    known = counts.filter("line").filter(F.col("term").isin(vocabulary))
    seen = {r["term"]: r["n"] for r in known.select("did", "h", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_files = counts.filter("line").select("did", "h").distinct().count()

    idf = {w: math.log((1.0 + n_files) / (1.0 + seen.get(w, 0))) + 1.0 for w in vocabulary}
    norms: dict[int, float] = {}
    for t, *_, w, n in of_template:
        norms[t] = norms.get(t, 0.0) + (n * idf[w]) ** 2
    of_word = literal_rows(spark, "term string, idf double", [(w, idf[w]) for w in vocabulary])
    parts = literal_rows(spark, "t int, name string, t_held string, t_kinds string, term string, t_w double", [(t, name, held, kinds, w, n * idf[w] / math.sqrt(norms[t])) for t, name, held, kinds, w, n in of_template])
    weighted = counts.join(F.broadcast(of_word), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(math.log(1.0 + n_files) + 1.0)))
    norm = weighted.groupBy("did", "h", "block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    agree = (F.col("kinds") == F.col("t_kinds")) & (F.size(F.array_except(F.split("t_held", " "), F.split(F.concat("held", F.lit(" ")), " "))) == 0)
    dot = (weighted.filter("idf is not null").join(F.broadcast(parts), "term").filter(agree).groupBy("did", "h", "block", "name", "t")
           .agg(F.sum(F.col("w") * F.col("t_w")).alias("dot")))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = F.min(F.struct((-cosine).alias("down"), "name")).alias("best")
    return (dot.join(norm, ["did", "h", "block"]).groupBy("did", "h").agg(best)
            .select("did", "h", F.col("best.name").alias("license"), (-F.col("best.down")).alias("score")).filter(F.col("score") >= cut))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest first, the root last: a/b/c.txt gives a/b, a and the empty root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, is_license_file: Column, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row for each file: doc_id, path, own_license, own_score, license, inherited_from (a directory or null)."""
    keyed = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), id_key(F.col(id_col), F.col(text_col)).alias("did"),
                         text_key(F.col(text_col)).alias("h"), F.coalesce(is_license_file, F.lit(False)).alias("speaks"), F.col(text_col).alias("text"))
    own = materialize(own_licenses(keyed.select("did", "h", "text"), cut), "own")
    all_files = materialize(keyed.drop("text").join(own, ["did", "h"], "left"), "files")
    near = ancestors(F.col("path"))
    of_dir = materialize(
        all_files.filter("speaks and license is not null and path is not null")
        .groupBy(near[0].alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("license").alias("name"))).alias("best"))
        .select("dir", F.col("best.name").alias("dir_license")), "dirs")
    bare = all_files.filter("license is null and path is not null").select("path").distinct()
    steps = bare.select("path", F.posexplode(near).alias("up", "dir"))
    nearest = (steps.join(of_dir, "dir").groupBy("path").agg(F.min(F.struct("up", "dir", "dir_license")).alias("hit"))
               .select("path", F.col("hit.dir").alias("inherited_from"), F.col("hit.dir_license").alias("dir_license")))
    nearest = materialize(nearest, "nearest")
    joined = all_files.join(nearest, "path", "left")
    return joined.select(
        "doc_id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"))
