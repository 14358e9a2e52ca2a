"""Licence scans, in DataFrame functions only.

The units of a file that may name a licence become sparse TF-IDF vectors and meet the templates' vectors on their
terms; the best cosine names the licence. Units are sentences and lines with a licence word, paragraphs with one
(comment signs stripped, wrapped lines in one piece), the run of comment lines that opens the file, and the whole
text of licence files. Templates are titles, statements, headers and whole texts (`license_texts`). A licence file
speaks for its directory. A file without a licence of its own takes that of the nearest ancestor directory that
has one: directories, not files, are exploded into their ancestors and joined on the path, so a directory with a
third of all files is one row.

Defined results: null and empty texts declare nothing; a null path has no directory and inherits
nothing; ties of a score go to the licence first in the alphabet, ties of licence files in a directory
to the better score and then the first path; equal rows give equal results (one row each); a very long text is
split into its units as a whole, and only units with a licence word are carried on; an empty table gives no rows.
Columns named own_license, own_score, license or license_from are replaced, all others but text are kept whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored
from cueloom.llm.license_texts import TEXTS

#: Words that a licence statement has at least one of.
MARKER = r"(?i)\b(licen[cs]e[ds]?|licen[cs]ing|spdx|copyleft|public domain|creative commons|cc0|cc by|permission is hereby granted|permission to use,\s+copy|redistribution and use|neither the name)\b"
#: Signs that open or close a comment, at the start or the end of a line.
COMMENT = r"^[ \t]*(/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--+)[ \t]*|[ \t]*(\*+/|--+>)[ \t\r]*$"
#: Base names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense|copyright)([-._].*)?$"
MIN_COSINE = 0.5

# Short statements and headers of public licences, one template per line.
STATEMENTS = {
    "0BSD": ["Licensed under the Zero-Clause BSD license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License)", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License", "Licensed under the Simplified BSD License"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work (public domain dedication)"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "ISC": ["Released under the ISC License"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Released under the Mozilla Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
}
#: SPDX tags name their licence themselves.
SPDX = "SPDX-License-Identifier: {name}"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def built_in() -> dict[str, list[str]]:
    return {k: [*v, SPDX.format(name=k), *TEXTS[k]] for k, v in STATEMENTS.items()}


def templates(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, template, text): the built-in ones, or others."""
    source = texts or built_in()
    rows = [(name, f"{name}#{i}", text) for name, own in sorted(source.items()) for i, text in enumerate(own)]
    return spark.createDataFrame(rows, "license string, template string, text string")


def template_vectors(known: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(term, idf), (term, template, license, weight) with unit-length weights, and the number of templates."""
    known = known.select("license", "template", F.explode(terms_of(F.col("text"))).alias("term"))
    tf = stored(known.groupBy("license", "template", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = tf.select("template").distinct().count()
    idf = stored(tf.groupBy("term").agg(F.log(1 + F.lit(float(n)) / F.count(F.lit(1))).alias("idf")))
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return idf, stored(raw.join(norm, "template").select("term", "template", "license", (F.col("w") / F.col("_n")).alias("weight"))), n


def statements(files: DataFrame) -> DataFrame:
    """(_key, unit, body): sentences, lines, paragraphs and the opening comment with a licence word, whole texts of licence files."""
    marked = files.where(F.col("text").rlike(MARKER) | F.col("is_license"))
    has_word = lambda u: u.rlike(MARKER)
    units = F.filter(F.split("text", r"\n|(?<=[.;!?])\s+"), has_word)
    lines = F.split("text", "\n")
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, COMMENT, "")))
    paragraphs = F.filter(F.split(F.array_join(bare, "\n"), "\n\n+"), has_word)
    # comment lines and empty ones up to the first other line
    other = F.array_position(F.transform(lines, lambda x: ~x.rlike(r"^[ \t]*(/\*|\*|//|#|;|--|%|<!--)|^[ \t\r]*$")), True)
    head = F.array_join(F.when(other > 0, F.slice(bare, F.lit(1), (other - 1).cast("int"))).otherwise(bare), "\n")
    none = F.expr("array_remove(array(''), '')")
    opening = F.when(head.rlike(MARKER), F.array(head)).otherwise(none)
    whole = F.when(F.col("is_license"), F.array("text")).otherwise(none)
    return marked.select("_key", F.posexplode(F.array_distinct(F.concat(units, paragraphs, opening, whole))).alias("unit", "body"))


def declared(files: DataFrame, known: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """(_key, license, score): the best licence of each file that declares one.

    Equal statements are scored once, however many files have them.
    """
    idf, vectors, n = template_vectors(known)
    idf, vectors = small_side(idf), small_side(vectors)
    # a statement is named by its hash from here on, so that no row but one carries its text
    units = statements(files).select("_key", "body", F.sha2("body", 256).alias("b"))
    owners = stored(units.select("_key", "b").distinct())
    terms = units.groupBy("b").agg(F.first("body").alias("body")).select("b", F.explode(terms_of(F.col("body"))).alias("term"))
    tf = terms.groupBy("b", "term").agg(F.count(F.lit(1)).alias("tf"))
    rare = math.log(1 + n)
    weighted = stored(tf.join(idf, "term", "left").select("b", "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("w")))
    norms = weighted.groupBy("b").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    dots = weighted.join(vectors, "term").groupBy("b", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("_d"))
    cosine = dots.join(norms, "b").select("b", "license", F.round(F.col("_d") / F.col("_n"), 6).alias("score")).where(F.col("score") >= least)
    best = cosine.groupBy("b").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    own = owners.join(best, "b").groupBy("_key").agg(F.min("best").alias("best"))
    return own.select("_key", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def parent_of(path: Column) -> Column:
    """The directory of a path; the empty string is the root, null for a null path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), "")


def inherited(dirs: DataFrame, owners: DataFrame) -> DataFrame:
    """(dir, inherited, inherited_from): the licence of the nearest of a directory's ancestors (itself included) that has one."""
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    exploded = dirs.select("dir", F.explode(F.array_distinct(up)).alias("above"))
    met = exploded.join(owners.select(F.col("dir").alias("above"), F.col("license").alias("_l")), "above")
    near = met.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "_l")).alias("m"))
    return near.select("dir", F.col("m._l").alias("inherited"), F.col("m.above").alias("inherited_from"))


def scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files (path, text, and any others but text kept) plus own_license, own_score, license, license_from.

    license_from is `own`, the directory it was inherited from, or null.
    """
    known = templates(files.sparkSession) if known is None else known
    names = [c for c in files.columns if c not in ("text", "own_license", "own_score", "license", "license_from")]
    # a row's own columns travel as one struct, so they may have any names
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    keyed = files.select(F.struct(*names).alias("_row"), "path", "text", F.coalesce(base.rlike(LICENSE_FILE), F.lit(False)).alias("is_license"), F.struct("path", F.xxhash64("text").alias("h")).alias("_key"))
    found = stored(declared(keyed.select("_key", "text", "is_license"), known))
    rows = keyed.select("_row", "path", "is_license", "_key", parent_of(F.col("path")).alias("_dir"))
    key = F.struct(F.coalesce(F.concat(F.lit("="), F.col("_key.path")), F.lit("-")).alias("p"), F.coalesce("_key.h", F.lit(0)).alias("h"))
    own = rows.withColumn("_k", key).join(small_side(found.select(key.alias("_k"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))), "_k", "left").drop("_k", "_key")
    own = stored(own)
    owners = own.where(F.col("is_license") & F.col("own_license").isNotNull() & F.col("_dir").isNotNull()).groupBy(F.col("_dir").alias("dir")).agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("o")
    )
    owners = stored(owners.select("dir", F.col("o.own_license").alias("license")))
    dirs = own.where(F.col("_dir").isNotNull()).select(F.col("_dir").alias("dir")).distinct()
    above = small_side(stored(inherited(dirs, owners)).withColumnRenamed("dir", "_dir"))
    out = own.join(above, "_dir", "left")
    return out.select(
        "_row.*",
        "own_license",
        "own_score",
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("inherited_from")).alias("license_from"),
    )


def first_line_marked() -> Column:
    """The first line of a text is a licence statement."""
    return F.coalesce(F.substring_index("text", "\n", 1).rlike(MARKER), F.lit(False))
