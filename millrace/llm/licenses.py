"""Licence scan: TF-IDF cosine to templates, then inheritance down the directories.

Method. Candidate units are the lines of any file that hold a marker word, and the whole text of
licence files. A unit and a template are sparse vectors of term counts times inverse document
frequencies (over the templates; terms that no template has weigh most). Terms of units meet those
of templates in a join on the term, and dot products are sums by unit and template. A file's own
licence is its best template with at least ``least`` cosine; a directory's is that of its best
licence file. A file without its own takes that of the nearest directory above it: the ancestors
of every directory are joined, by path, with the directories that have a licence, and the longest
path wins.

Headers that wrap over lines, SPDX lines and whole licence texts are recognised, text by text, by
:mod:`millrace.llm.notices`; where one of these fits a file best, it is the file's own licence.

Defined cases: null text is empty and has no licence; a null path is a file in no directory, which
has its own licence and inherits none; very long texts are searched whole, by lines, paragraphs and
comments; ties go to the earlier template, and between licence files to the smaller path; a file is
a (path, text) pair, so repeated rows get equal results; other columns than those named are ignored.
A directory of very many files is one row in the tables of directories; the join that gives each
file its directory's licence has no texts and is left to Spark's handling of skewed joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import notices
from millrace.llm.common import slices, stored

#: Short public notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT license"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms are permitted."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0, no copyright reserved."),
)
#: Words that make a line a candidate, and names of licence files.
MARKER = "licen[sc]|copyright|spdx|public domain"
LICENCE_FILE = "(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$"
TERM = "[a-z0-9]+"


def _vectors(spark: SparkSession) -> tuple[DataFrame, float]:
    """(template, term, weight, norm) of all templates, and the weight of a term that none has."""
    import re

    words = [re.findall(TERM, text.lower()) for _, text in TEMPLATES]
    n = len(words)
    idf = {w: math.log((1 + n) / (1 + sum(w in x for x in words))) + 1 for x in words for w in x}
    rows = []
    for i, x in enumerate(words):
        weights = {w: x.count(w) * idf[w] for w in dict.fromkeys(x)}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        rows += [(i, w, weights[w], idf[w], norm) for w in weights]
    return spark.createDataFrame(rows, "template int, term string, weight double, idf double, norm double"), math.log(1 + n) + 1


def parent(path: Column) -> Column:
    """The directory of a path; the empty one is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def standard_licences(rows: DataFrame, least: float) -> DataFrame:
    """(path, sig, s_licence, s_score) of the (path, sig, text) that a standard notice fits best."""
    likely = rows.where(F.rlike(F.lower("text"), F.lit(notices.HINT))).select("path", "sig", F.rlike(F.coalesce("path", F.lit("")), F.lit(LICENCE_FILE)).alias("whole"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [notices.declared(t, w, TEMPLATES, least) for w, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            hit = pa.array([x is not None for x in found], pa.bool_())
            names = pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *names], names=["path", "sig", "s_licence", "s_score"]).filter(hit)

    return likely.mapInArrow(work, "path string, sig bigint, s_licence string, s_score double").distinct()


def own_licences(files: DataFrame, *, path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """(path, sig, licence, score) of the files that declare one."""
    spark = files.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = files.select(F.col(path_col).alias("path"), F.xxhash64(text).alias("sig"), text.alias("text"))
    marked = F.filter(F.split("text", "\n"), lambda x: F.rlike(F.lower(x), F.lit(MARKER)))
    units = F.when(F.rlike(F.coalesce("path", F.lit("")), F.lit(LICENCE_FILE)), F.concat(marked, F.array("text"))).otherwise(marked)
    units = rows.select("path", "sig", F.explode(units).alias("unit"))
    numbered = stored(units.select("path", "sig", F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0)).alias("terms")).distinct().withColumn("unit", F.monotonically_increasing_id()), "licence-units")
    vectors, unknown = _vectors(spark)
    # The templates are a fixed list, so these broadcasts have a fixed size.
    idf = F.broadcast(vectors.select("term", "idf").distinct())
    terms = numbered.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n"))
    weighed = terms.join(idf, "term", "left").select("unit", "term", (F.col("n") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(F.broadcast(vectors.select("term", "template", "weight", "norm")), "term").groupBy("unit", "template", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "template", F.round(F.col("dot") / (F.col("size") * F.col("norm")), 4).alias("score")).where(F.col("score") >= least)
    best = scored.join(numbered.select("unit", "path", "sig"), "unit").groupBy("path", "sig").agg(F.max(F.struct("score", (-F.col("template")).alias("order"))).alias("best"))
    names = F.array(*(F.lit(x) for x, _ in TEMPLATES))
    lines = best.select("path", "sig", F.get(names, -F.col("best.order")).alias("licence"), F.col("best.score").alias("score"))
    named = standard_licences(rows, least).select(F.col("path").alias("s_path"), F.col("sig").alias("s_sig"), "s_licence", "s_score")
    both = lines.join(named, F.col("path").eqNullSafe(F.col("s_path")) & (F.col("sig") == F.col("s_sig")), "full")
    own = F.col("sig").isNotNull()
    return both.select(F.when(own, F.col("path")).otherwise(F.col("s_path")).alias("path"), F.coalesce("sig", "s_sig").alias("sig"), F.coalesce("s_licence", "licence").alias("licence"), F.coalesce("s_score", "score").alias("score"))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", least: float = 0.6, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row a file: path, own (licence or null), score (0 where none), licence, inherited_from (directory or null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = files.select(F.col(path_col).alias("path"), F.xxhash64(text).alias("sig"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carried)))
    found = stored(own_licences(files, path_col=path_col, text_col=text_col, least=least), "licences")
    ranked = found.where(F.rlike("path", F.lit(LICENCE_FILE))).select(parent(F.col("path")).alias("dir"), "score", "licence", "path")
    top = ranked.groupBy("dir").agg(F.max("score").alias("top"))
    governed = ranked.join(top.withColumnRenamed("dir", "d"), (F.col("dir") == F.col("d")) & (F.col("score") == F.col("top"))).groupBy("dir").agg(F.min_by("licence", F.struct("path", "licence")).alias("dir_licence"))
    # Directories are far fewer than files, so a directory of many files is resolved once.
    dirs = rows.where("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    lines = dirs.select("dir", F.explode(F.array_distinct(above)).alias("ancestor"))
    near = lines.join(governed.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "dir_licence")).alias("near"))
    files_found = found.select(F.col("path").alias("f_path"), F.col("sig").alias("f_sig"), "licence", "score")
    same = F.col("path").eqNullSafe(F.col("f_path")) & (F.col("sig") == F.col("f_sig"))
    out = rows.withColumn("dir", parent(F.col("path"))).join(files_found, same, "left").join(near, "dir", "left")
    inherited = F.col("licence").isNull() & F.col("near").isNotNull()
    return out.select(
        F.col("path").alias(path_col),
        F.col("licence").alias("own"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("licence", "near.dir_licence").alias("licence"),
        F.when(inherited, F.col("near.ancestor")).alias("inherited_from"),
        *(F.col(f"c_{i}").alias(c) for i, c in enumerate(carried)),
    )
