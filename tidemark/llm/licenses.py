"""License scans: headers and licence files by TF-IDF cosine to templates, inherited from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Licence templates (name, text), as headers and notices state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Proprietary", "All rights reserved."),
)
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([-_.].*)?$"
#: Words that carry no weight.
STOP = "a all and any are as at by can for from in into is it may not of on or provided that the this to under with without you".split()


def terms(text: str) -> list[str]:
    return [t for t in re.findall(r"[a-z0-9]+", text.lower()) if t not in STOP]


def weights(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies over the templates, and each template's unit vector."""
    counted = [(name, Counter(terms(text))) for name, text in templates]
    df = Counter(t for _, c in counted for t in c)
    idf = {t: math.log((1 + len(counted)) / (1 + n)) + 1 for t, n in df.items()}
    unit = []
    for name, c in counted:
        size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        unit.append((name, {t: n * idf[t] / size for t, n in c.items()}))
    return idf, unit


def anchors(unit: list[tuple[str, dict[str, float]]], least: float) -> list[str]:
    """Terms of which a text has one if its cosine to any template is ``least`` or more.

    Of each template the heaviest terms, so many that the rest has a norm below ``least``.
    """
    out: set[str] = set()
    for _, vector in unit:
        rest = 1.0
        for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < least * least:
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def clue(unit: list[tuple[str, dict[str, float]]], least: float) -> str:
    """An expression that finds an anchor term."""
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors(unit, least)) + r")(?![a-z0-9])"


def file_templates() -> tuple[tuple[str, str], ...]:
    """Whole public licence texts, a file each in ``license_texts``: what licence files hold besides the header sentences."""
    folder = files("tidemark.llm") / "license_texts"
    return tuple((f.name.removesuffix(".txt"), f.read_text()) for f in sorted(folder.iterdir(), key=lambda f: f.name))


def matches(texts: DataFrame, templates=TEMPLATES, least: float = 0.7, hint: bool = True) -> DataFrame:
    """The best template of each text: ``key, license, cosine``, where the cosine is ``least`` or more.

    ``texts(key, text)`` are lines or whole files, a key each. Terms outside the templates weigh as
    the rarest do. Only texts with an anchor term are split (all, without ``hint``). The sparse vectors meet the
    templates' in one broadcast table by term, whose size is that of the templates; a text's norm and its products
    with all templates are sums of one grouping. Ties go to the first name.
    """
    idf, unit = weights(templates)
    rare = math.log(1 + len(unit)) + 1
    words = f"filter(split(lower(text), '[^a-z0-9]+'), t -> t <> '' and t not in ({', '.join(map(repr, STOP))}))"
    asked = texts.where(F.col("text").rlike(clue(unit, least))) if hint else texts
    found = asked.select("key", F.explode(F.expr(words)).alias("term")).repartition("key").groupBy("key", "term").agg(F.count("*").alias("n"))
    known = texts.sparkSession.createDataFrame([(t, w, [v.get(t, 0.0) for _, v in unit]) for t, w in idf.items()], "term string, idf double, weights array<double>")
    weighed = found.join(F.broadcast(known), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare)))
    dots = weighed.groupBy("key").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.col("weights")[i]).alias(f"d{i}") for i in range(len(unit)))
    )
    best = F.array_min(F.array(*(F.struct((-F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.col("norm"), 6)).alias("c"), F.lit(name).alias("license")) for i, (name, _) in enumerate(unit))))
    return dots.select("key", best.alias("b")).where(F.col("b.c") <= -least).select("key", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """What is before the last slash; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def ancestors(path: Column) -> Column:
    """A directory and all above it, the top (empty) included."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.array(F.lit(""))))


def scan(texts: DataFrame, templates=TEMPLATES, least: float = 0.7, share: float = 0.5) -> DataFrame:
    """Licences of files: ``id, path, license, cosine, origin, from_path``.

    ``texts(id, path, text)``. A file's own licence is the best template among its lines (``origin``
    ``header``), or for a file with one of the names of licence files the best of its whole text,
    against the same templates and against whole licence texts (``file``). A file with such a name,
    or of whose words the matching lines are ``share`` or more, governs its directory and all below;
    a file without a licence of its own takes that of the nearest ancestor directory that has one
    (``inherited``), the first name where several files govern one. Texts are read once for their
    lines with an anchor term, which are written to the shared folder; equal lines are weighed
    once. Directories are reduced to distinct ones before they are joined to their ancestors.

    Null and empty texts have no licence of their own but inherit; a null path is its own place,
    it neither governs nor inherits; null ids and repeated rows stay, each with its own result where rows of one id and
    path differ in text. An empty table gives an empty table; other columns are ignored.
    """
    # rows are told apart by id, path and text: equal rows have equal lines and one result
    row = F.xxhash64("text")
    known = texts.select("id", "path", "text")
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    hint = F.col("text").rlike(clue(weights(templates)[1], least))
    lines = cut(
        known.where(hint | named)
        .select(
            F.struct(F.col("id").alias("id"), F.col("path").alias("path"), row.alias("row")).alias("file"), named.alias("named"), words(F.col("text")).alias("size"),
            F.explode(F.when(named, F.array("text")).otherwise(F.split("text", "\n"))).alias("text"),
        )
        .where(hint | F.col("named")).withColumn("key", F.md5("text")).withColumn("part", words(F.col("text")))
    )
    short = matches(lines.groupBy("key").agg(F.any_value("text").alias("text")), templates, least)
    whole = matches(lines.where("named").groupBy("key").agg(F.any_value("text").alias("text")), file_templates(), least, hint=False)
    best = cut(short.withColumn("whole", F.lit(False)).union(whole.withColumn("whole", F.lit(True))))
    hits = lines.drop("text").join(best, "key").where("named or not whole")
    own = cut(
        hits.groupBy("file").agg(
            F.array_min(F.collect_set(F.struct((-F.col("cosine")).alias("c"), "license"))).alias("best"), F.max("named").alias("named"),
            F.sum("part").alias("part"), F.max("size").alias("size"),
        ).select("file.*", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), "named", (F.col("named") | (F.col("part") >= share * F.col("size"))).alias("governs"))
    )
    governed = (
        own.where("governs and path is not null").select(directory(F.col("path")).alias("place"), F.struct("path", "license").alias("by"))
        .groupBy("place").agg(F.min("by").alias("by"))
    )
    places = known.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    nearest = (
        places.select("dir", F.explode(ancestors(F.col("dir"))).alias("place")).join(governed, "place")
        .groupBy("dir").agg(F.max(F.struct(F.length("place").alias("depth"), "by")).alias("near")).select("dir", F.col("near.by").alias("by"))
    )
    mine = own.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("row").alias("_row"), F.col("license").alias("own"), F.col("cosine"), "named")
    return (
        known.select("id", "path", row.alias("row"), directory(F.col("path")).alias("dir"))
        .join(mine, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")) & (F.col("row") == F.col("_row")), "left").join(nearest, "dir", "left")
        .select(
            "id", "path", F.coalesce("own", "by.license").alias("license"), "cosine",
            F.when(F.col("own").isNotNull(), F.when(F.col("named"), "file").otherwise("header")).when(F.col("by").isNotNull(), "inherited").alias("origin"),
            F.when(F.col("own").isNull(), F.col("by.path")).alias("from_path"),
        )
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, each a file ``source/hundred/doc_id`` in a folder of its source."""
    from tidemark.tables import table

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")).alias("path"), "text"
    )
    return scan(docs).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    _, unit = weights()
    idf, rare = weights()[0], math.log(1 + len(unit)) + 1
    vector = ", ".join(f"({i}, '{name}', '{t}', {w!r}::DOUBLE)" for i, (name, v) in enumerate(unit) for t, w in v.items())
    known = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())
    return rf"""
WITH v(template, license, term, weight) AS (VALUES {vector}), k(term, idf) AS (VALUES {known}),
files AS (SELECT doc_id, concat_ws('/', source, (doc_id // 100)::VARCHAR, doc_id::VARCHAR) AS path, concat_ws('/', source, (doc_id // 100)::VARCHAR) AS dir, source, text FROM documents),
lines AS (SELECT doc_id, path, dir, source, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS size, unnest(string_split(text, chr(10))) AS line FROM files),
texts AS (SELECT DISTINCT line FROM lines),
words AS (SELECT line, term, count(*) AS n FROM (SELECT line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM texts) WHERE term NOT IN ({", ".join(map(repr, STOP))}) GROUP BY ALL),
w AS (SELECT line, words.term, n * coalesce(idf, {rare!r}::DOUBLE) AS w FROM words LEFT JOIN k USING (term)),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY line),
dots AS (SELECT line, template, license, sum(w * weight) AS dot FROM w JOIN v USING (term) GROUP BY ALL),
scored AS (SELECT line, license, round(dot / norm, 6) AS cosine FROM dots JOIN norm USING (line) WHERE round(dot / norm, 6) >= 0.7),
best AS (SELECT line, min({{'c': -cosine, 'license': license}}) AS best FROM scored GROUP BY line),
hits AS (SELECT lines.*, best.best AS best, len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) AS part FROM lines JOIN best USING (line)),
own AS (SELECT doc_id, path, dir, source, min(best) AS best, sum(part) >= 0.5 * max(size) AS governs FROM hits GROUP BY ALL),
gov AS (SELECT dir AS place, min({{'path': path, 'license': best.license}}) AS by FROM own WHERE governs GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(o.best.license, a.by.license) AS license, -o.best.c AS cosine,
  CASE WHEN o.doc_id IS NOT NULL THEN 'header' WHEN a.by IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.doc_id IS NULL THEN a.by.path END AS from_path
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN gov a ON a.place = f.dir
"""


OP4_SQL = _sql()
