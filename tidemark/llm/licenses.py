"""Licences of files from notices in them and from licence files above them.

Only DataFrame functions are used. Every line of a file is compared with
templates of notices by the cosine of sparse TF-IDF vectors; the inverse
document frequencies are counted over all files. The best line from
`THRESHOLD` on is the file's own licence. A file without one takes that of
the nearest directory above it that has a licence file with a licence; the
ancestors of a path are joined with those directories.

The vectors of lines are only made where a line has a distinctive term of some
template: a template's other terms together cannot reach the threshold, so
nothing is lost.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, words_of
from tidemark.session import checkpointed

THRESHOLD = 0.6
#: Most different words that all templates together may have.
VOCABULARY = 20_000

#: Notices by licence. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Names of licence files, without extension, lower-cased. Fixed values.
LICENSE_FILES = ("license", "licence", "copying", "unlicense")


def _tokens(spark, templates) -> dict[str, Counter]:
    rows = spark.createDataFrame(list(templates), "license string, text string").select("license", words_of(F.col("text")).alias("w"))
    return {r.license: Counter(r.w) for r in rows.collect()}


def _distinctive(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms without any of which no line reaches the threshold with any template."""
    out = set()
    for vector in vectors.values():
        whole, sum_ = sum(v * v for v in vector.values()), 0.0
        for term, value in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            sum_ += value * value
            if sum_ >= (threshold - 1e-6) ** 2 * whole:
                out.add(term)
    return sorted(out)


def _lines(text: Column) -> Column:
    return F.split(text, r"\n")


def notices(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Best template of each file (columns path, text) that reaches the threshold:
    path, license, score (to six places); the first licence of equals."""
    spark = files.sparkSession
    terms = _tokens(spark, templates)
    vocabulary = sorted({w for c in terms.values() for w in c})
    if len(vocabulary) > VOCABULARY:
        raise ValueError(f"templates with more than {VOCABULARY} different words")
    if not vocabulary:
        return files.select("path", F.lit("").alias("license"), F.lit(0.0).alias("score")).filter("false")
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    counted = files.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), known), F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # One row for each word of the templates, and one for all files.
    use = {r.word: r.n for r in counted.collect()}
    total = use.pop("", 0)
    weight = {w: math.log((1 + total) / (1 + use.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + total) + 1
    vectors = {k: {w: n * weight[w] for w, n in c.items()} for k, c in terms.items()}
    marks = F.split(F.lit(" ".join(_distinctive(vectors, threshold))), " ")

    lines = files.select("path", F.filter(_lines(F.col("text")), lambda l: F.arrays_overlap(words_of(l), marks)).alias("lines"))
    words = checkpointed(held(lines, "lines").select("path", F.posexplode("lines").alias("line", "text")).select("path", "line", F.explode(words_of(F.col("text"))).alias("word")))
    weights = spark.createDataFrame([(w, v) for w, v in weight.items()], "word string, weight double")
    parts = spark.createDataFrame(
        [(k, w, v, math.sqrt(sum(x * x for x in vec.values()))) for k, vec in vectors.items() for w, v in vec.items()],
        "license string, word string, value double, norm double",
    )
    tf = words.groupBy("path", "line", "word").agg(F.count("*").alias("tf")).join(weights, "word", "left").withColumn(
        "w", F.col("tf") * F.coalesce("weight", F.lit(unseen))
    )
    norms = tf.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    dots = tf.join(parts, "word").groupBy("path", "line", "license").agg(F.sum(F.col("w") * F.col("value")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.join(norms, [dots.path.eqNullSafe(norms.path), dots.line == norms.line]).select(
        dots.path, "license", F.round(F.col("dot") / (F.col("norm") * F.col("line_norm")), 6).alias("score")
    ).filter(F.col("score") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("lower"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.lower")).alias("score"))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def licenses(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """path, license, score, origin (own, inherited, none), from_path, one row per path.

    A licence file counts by its name (`LICENSE_FILES`, any case, any
    extension); of several in a directory the one with the highest score, then
    the first path, holds. Rows with one path are one file whose lines all
    count. Null and empty texts have no notice; a null path has no ancestors.
    Other columns are not read. An empty table gives an empty result.
    """
    given = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = checkpointed(notices(given, templates, threshold))
    paths = given.select("path").distinct()
    a, b = paths.alias("a"), own.alias("b")
    known = a.join(b, F.col("a.path").eqNullSafe(F.col("b.path")), "left").select("a.path", "license", "score")

    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    holders = checkpointed(
        own.filter(name.isin(*LICENSE_FILES)).groupBy(_parent(F.col("path")).alias("dir"))
        .agg(F.min(F.struct((-F.col("score")).alias("lower"), F.col("path").alias("from_path"), "license")).alias("h"))
        .select("dir", "h.license", (-F.col("h.lower")).alias("score"), "h.from_path")
    )
    steps = F.split(_parent(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("dir")))
    reached = (
        known.filter("license IS NULL AND path IS NOT NULL").select("path", F.inline(above)).dropDuplicates(["path", "dir"])
        .join(holders, "dir").groupBy("path").agg(F.max(F.struct("depth", "license", "score", "from_path")).alias("near"))
    )
    whole = known.join(reached, "path", "left")
    return whole.select(
        "path", F.coalesce("license", "near.license").alias("license"), F.coalesce("score", "near.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("near.from_path")).alias("from_path"),
    )
