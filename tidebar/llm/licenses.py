"""Licences of documents: notices by sparse TF-IDF cosine to templates, then inheritance by directory.

Every line that names a licensing term is a notice.  Notices are counted as distinct lines first, so
a notice on a third of all documents is scored once.  Term vectors stay sparse rows (line, term,
weight); their cosine with each template is one join on terms with the template table (fixed size,
so it is broadcast) and one aggregation.

A document without a notice takes the licence of its directory's licence file, or of the nearest
ancestor directory that has one.  Directories are resolved among themselves first (one row each), so
documents meet one row by one join, whatever the share of a directory.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Opening notices of well-known licences
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "proprietary": "Copyright. All rights reserved.",
}
NOTICE = r"(?i)licen[sc]e|copyright|spdx|all rights reserved|public domain|permission to use|redistribution and use"
LEAST = 0.6  # cosine from which a notice counts as its template
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, UPPER, LOWER), F.lit("[a-z0-9]+"), 0)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, deepest first."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, dir, line: every notice line of every document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOTICE))
    return docs.where(F.col("text").rlike(NOTICE)).select("row_id", "doc_id", "dir", F.explode(lines).alias("line"))


def match_lines(lines: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """line, licence, score of the distinct lines (line, n) that reach a template.

    Inverse document frequency counts every occurrence of a line and every template as a document.
    Of equal scores the first name wins.
    """
    both = lines.select("line", "n").unionByName(templates.groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n")))
    seen = both.groupBy("line").agg(F.sum("n").alias("n")).withColumn("term", F.explode(F.array_distinct(terms_of(F.col("line")))))
    idf = seen.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(both.agg(F.sum("n").alias("total"))))  # one row
    idf = idf.select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    names = templates.select("licence", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    names = names.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = names.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm_t"))
    names = names.select("licence", "term", F.col("w").alias("w_t")).join(norms, "licence")
    words = lines.select("line", F.explode(terms_of(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    words = words.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = words.groupBy("line").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = words.join(F.broadcast(names), "term").groupBy("line", "licence", "norm_t").agg(F.sum(F.col("w") * F.col("w_t")).alias("dot"))
    scores = dots.join(norm, "line").select("line", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("norm_t")), 6).alias("score"))
    best = scores.groupBy("line").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("line", "b.licence", "b.score")


def license_scan(docs: DataFrame, path: Column, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, licence, score, origin (notice, directory, none), licence_dir, n_notices.

    ``path`` gives each row's file path, parts separated by ``/``.  A document's own licence is its
    best notice (ties: first name); the licence file of a directory is the document directly in it
    with a notice and the smallest doc_id.  Documents without one inherit from the nearest directory
    that has a licence file, their own first.  Null and empty texts have no notices; a null path has
    no directory; a null doc_id comes after all others.  Rows are kept as they are, repeated ones
    too; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    names = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in sorted((TEMPLATES if templates is None else templates).items()) for x in kv])).alias("licence", "text"))
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), folder.alias("dir"))
    rows = rows.withColumn("row_id", F.xxhash64("doc_id", "dir", "text"))
    found = notices(rows)
    lines = found.groupBy("line").agg(F.count("*").alias("n"))
    matched = match_lines(lines, names, least)
    own = found.join(matched, "line").groupBy("row_id", "doc_id", "dir").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence"))).alias("own"), F.countDistinct("line").alias("n_notices")
    )
    files = own.where("dir is not null").groupBy("dir").agg(F.min_by("own.licence", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("own.licence"))).alias("licence"))
    folders = rows.where("dir is not null").select("dir").distinct()
    up = folders.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("steps", "above"))
    near = up.join(files.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.min_by(F.struct("above", "licence"), "steps").alias("near"))
    out = rows.drop("text").join(own.select("row_id", "own", "n_notices"), "row_id", "left").join(near, "dir", "left")
    mine, near_licence = F.col("own.licence"), F.col("near.licence")
    return out.select(
        "doc_id",
        F.coalesce(mine, near_licence).alias("licence"),
        F.col("own.score").alias("score"),
        F.when(mine.isNotNull(), "notice").when(near_licence.isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(mine.isNull(), F.col("near.above")).alias("licence_dir"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
    )
