"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory (operator 3).

Headers (the leading comment block, marks stripped, lines joined) and the whole texts of files named like licence files are vectors
over all their terms; their templates are whole licence texts (license_texts), licence titles and the notices below, and inverse
frequencies are those over the templates, a word of no template weighing most.  The best template at or above `least`
is the file's licence.  Sentences that name a licence matter and go over line ends are joined and scored in the same way,
but count as units do.  Units are for prose, where a header has no licence:

Units are the lines and sentences of a whole text that name a licence matter (MARKERS).  Distinct units are
counted first, so a notice that a third of all files carry is one row.  A unit's vector holds the words and word
pairs of the templates' vocabulary that it has, weighed by term count and inverse frequency over the units of all files;
dot products come from one equi-join on terms.  The best template at or above `least` (ties: the smaller name) is the
unit's licence, and a file's licence is that of its best unit.

A file named like a licence file, or whose licence units make up at least `share` of its words, speaks for its
directory (several: best score, then smallest path).  Files without a licence take that of the nearest ancestor directory
that has one: distinct directories are expanded to their ancestors and joined by path, then files join their directory.

Rows: a null text has no unit; a null path has no directory, so the file keeps its own licence or none; repeated
rows each get a row; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MARKERS = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|public domain"
LEAST, SHARE = 0.6, 0.1
TOKEN = r"[a-z0-9]+"
#: Notices as their licences word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
)

#: Licences of which license_texts has the whole text, and those of which it has the notice for headers.
TEXTS = ("Apache-2.0", "Artistic-1.0", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense")
NOTICES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")
TITLES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
NAMED = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
_MARK = r"(?:/\*+|\*+/?|#+!?|//+|--+|;+|%+|<!--|\.\. |dnl\b|REM\b)"
_HEADER = r"^\x{FEFF}?(?:#![^\n]*\n)?(?:<\?[^\n]*\n)?\s*(/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|(?:[ \t]*(?:#|//|--|;|%|\.\. |dnl\b|REM\b)[^\n]*(?:\n|$))++)"
_GAP = r"[\s#*/;%-]+"


@cache
def passage_templates() -> tuple[list[tuple[int, str, str, float]], list[tuple[str, float]], float]:
    """(template number, licence, term, share of the unit vector), (term, inverse frequency), that of a term of no template."""
    read = lambda name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
    whole = [(n, read(n)) for n in TEXTS] + [(n, read(f"{n}.notice")) for n in NOTICES]
    counts: dict[int, tuple[str, dict[str, int]]] = {}
    for k, name, t, c in template_terms((*TEMPLATES, *TITLES, *whole)):
        counts.setdefault(k, (name, {}))[1][t] = c
    df = Counter(t for _, c in counts.values() for t in c)
    none = math.log(1 + len(counts)) + 1
    idf = {t: none - math.log(1 + n) for t, n in df.items()}
    rows = []
    for k, (name, c) in counts.items():
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(k, name, t, x / norm) for t, x in v.items()]
    return rows, list(idf.items()), none


def terms_of(unit: Column) -> Column:
    """Words and neighbouring pairs of words."""
    words = F.regexp_extract_all(F.lower(unit), F.lit(TOKEN), F.lit(0))
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.concat(words, F.filter(pairs, lambda p: p.contains(" ")))


def template_terms(templates=TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template number, licence, term, count)."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = re.findall(TOKEN, text.lower())
        counts: dict[str, int] = {}
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            counts[t] = counts.get(t, 0) + 1
        out += [(k, name, t, c) for t, c in counts.items()]
    return out


def units_of(files: DataFrame) -> DataFrame:
    """path, text -> path, n_words, units (array of the units that name a licence matter)."""
    units = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.;])[ \t]+"), lambda u: u.rlike(MARKERS))
    return files.withColumn("units", F.transform(units, F.trim))


def judged_units(units: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """unit, license, score of each distinct unit that reaches `least`."""
    spark = units.sparkSession
    distinct = stored(units.groupBy("unit").agg(F.count("*").alias("files")), "license-units")
    table = F.broadcast(spark.createDataFrame(template_terms(templates), "template int, license string, term string, count int"))
    vocabulary = table.select("term").distinct()  # of the templates alone: a few hundred terms
    found = distinct.select("unit", "files", F.explode(terms_of(F.col("unit"))).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("unit", "files", "term").agg(F.count("*").alias("tf"))
    found = stored(found, "license-terms")
    total = distinct.agg(F.sum("files").alias("total"))
    idf = vocabulary.join(found.groupBy("term").agg(F.sum("files").alias("df")), "term", "left").crossJoin(total)
    idf = F.broadcast(idf.select("term", (F.log((1 + F.coalesce("total", F.lit(0))) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")))
    ours = found.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    theirs = table.join(idf, "term").withColumn("v", F.col("count") * F.col("idf"))
    norm_v = F.broadcast(theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_v")))
    norm_w = ours.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_w"))
    dots = ours.join(F.broadcast(theirs.select("template", "license", "term", "v")), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm_v, "template").join(norm_w, "unit").withColumn("score", F.round(F.col("dot") / (F.col("norm_v") * F.col("norm_w")), 6))
    best = scored.where(F.col("score") >= least).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("m"))
    return best.select("unit", "m.license", (-F.col("m.minus")).alias("score"))


def passages_of(path: Column, text: Column) -> Column:
    """Array of (part, passage): part is false for headers and whole licence files, true for sentences over line ends."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda t: F.regexp_replace(t, rf"(?m)^[ \t]*{_MARK}?[ \t]*", F.lit(""))
    joined = lambda t: F.trim(F.regexp_replace(t, r"\s+", F.lit(" ")))
    sentences = F.filter(F.split(bare(text), r"(?<=[.;])\s+|\n\s*\n"), lambda x: F.trim(x).contains("\n"))
    sentences = F.filter(F.transform(sentences, joined), lambda x: x.rlike(MARKERS))
    named = lambda part, xs: F.transform(xs, lambda x: F.struct(F.lit(part).alias("part"), x.alias("passage")))
    whole = F.array(joined(bare(F.regexp_extract(text, _HEADER, 1))), F.when(path.rlike(NAMED), joined(text)))
    whole = F.filter(whole, lambda x: F.coalesce(x, F.lit("")) != "")
    wrapped = F.when(text.rlike(MARKERS.replace(" ", _GAP)), sentences).otherwise(F.array().cast("array<string>"))
    return F.concat(named(False, whole), named(True, wrapped))


def judged_passages(passages: DataFrame, least: float = LEAST) -> DataFrame:
    """passage, license, score of each distinct passage that reaches `least`."""
    spark = passages.sparkSession
    rows, known, none = passage_templates()
    theirs = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, v double"))
    idf = F.broadcast(spark.createDataFrame(known, "term string, idf double"))
    distinct = stored(passages.select("passage").distinct().withColumn("id", F.md5("passage")), "license-passages")
    tf = distinct.select("id", F.explode(terms_of(F.col("passage"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    ours = stored(tf.join(idf, "term", "left").select("id", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(none))).alias("w")), "license-passage-terms")
    norm = ours.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = ours.join(theirs, "term").groupBy("id", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("m"))
    return distinct.join(best, "id").select("passage", "m.license", (-F.col("m.minus")).alias("score"))


def directory(path: Column) -> Column:
    """The directory of an absolute path; that of a file at the top is the empty string."""
    return F.regexp_replace(path, r"/[^/]*$", F.lit(""))


def ancestors(path: Column) -> Column:
    """The directory and all above it, with the top (the empty string)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame, templates=TEMPLATES, *, path_col: str = "path", text_col: str = "text", least: float = LEAST, share: float = SHARE) -> DataFrame:
    """The rows' other columns apart from the text, with path, license, score, origin (own, inherited, none) and licensed_dir; input
    columns of these names are replaced.  Rows are told apart by 128 bits of hash, and rows alike in all columns share a verdict."""
    rest = [c for c in files.columns if c not in (path_col, text_col) and c.lower() not in ("path", "license", "score", "origin", "licensed_dir")]
    names = [f"c{i}" for i in range(len(rest))]  # inside, so that no column of theirs meets one of ours
    rows = files.select(*(F.col(c).alias(n) for c, n in zip(rest, names)), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = units_of(rows).withColumn("key", F.struct(F.xxhash64("path", "text", *names).alias("a"), F.xxhash64(F.lit(1), "text", "path", *names).alias("b")))
    n_words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), F.lit(0)))
    carry = rows.where(F.size("units") > 0).select("key", "path", n_words.alias("n_words"), F.explode("units").alias("unit"))
    units = stored(carry.dropDuplicates(["key", "unit"]), "license-lines")
    known = stored(judged_units(units, templates, least), "license-scores")
    passed = rows.select("key", "path", n_words.alias("n_words"), F.explode(passages_of(F.col("path"), F.col("text"))).alias("p")).select("key", "path", "n_words", "p.*")
    passed = stored(passed.dropDuplicates(["key", "part", "passage"]), "license-parts")
    read = passed.join(judged_passages(passed, least), "passage")
    n_own = lambda c: F.size(F.split(c, r"\s+"))
    hits = units.join(known, "unit").select("key", "path", "n_words", F.lit(True).alias("part"), "score", "license", n_own("unit").alias("n_unit"), F.lit(0).alias("n_part"), F.lit(0).alias("n_whole"))
    hits = hits.unionByName(read.select("key", "path", "n_words", "part", "score", "license", F.lit(0).alias("n_unit"), F.when(F.col("part"), n_own("passage")).otherwise(0).alias("n_part"), F.when(F.col("part"), 0).otherwise(n_own("passage")).alias("n_whole")))
    hits = hits.groupBy("key", "path", "n_words").agg(F.min(F.struct("part", (-F.col("score")).alias("minus"), "license")).alias("m"), F.greatest(F.sum("n_unit"), F.sum("n_part"), F.max("n_whole").cast("long")).alias("own_words"))
    own = stored(hits.select("key", "path", "m.license", (-F.col("m.minus")).alias("score"), (F.col("path").rlike(NAMED) | (F.col("own_words") >= share * F.col("n_words"))).alias("speaks")), "licenses")
    of_dir = own.where("speaks and path is not null").groupBy(directory(F.col("path")).alias("licensed_dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("m")).select("licensed_dir", F.col("m.license").alias("dir_license"))
    plain = rows.select(*names, "path", "key", directory(F.col("path")).alias("dir"))
    dirs = plain.where("dir is not null").select("dir").distinct()
    nearest = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("licensed_dir")).join(of_dir, "licensed_dir").groupBy("dir").agg(F.max_by(F.struct("licensed_dir", "dir_license"), F.length("licensed_dir")).alias("up"))
    joined = plain.join(own.select("key", "license", "score").dropDuplicates(["key"]), "key", "left").join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return joined.select(*(F.col(n).alias(c) for c, n in zip(rest, names)), "path", F.coalesce("license", "up.dir_license").alias("license"), "score", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("up.licensed_dir")).alias("licensed_dir"))
