"""Licence scan: TF-IDF cosine of lines to templates, then inheritance from the nearest directory that has a licence.

*Match.* A template is a short notice. Its terms' document frequencies are counted over all documents; every other term
weighs as one that occurs nowhere. Each line of a document is compared with each template by cosine; the best pair of
at least ``min_cosine`` is the document's own licence (of equal ones the greatest name). Only lines with a telling term
are scored: the terms of a template are taken from the lightest on as long as their squared weights stay below
``min_cosine`` squared, and a line that shares none of the others cannot reach ``min_cosine``.

Where no line equals a template, windows of words are compared too, with all notices (short forms, headers, what licence
files begin with): each window is as long as the notice and lies so that a telling term is in its place, whatever
line ends and other words are around it. A window counts if it is better than the best line.

*Inherit.* Files named as licence files (LICENSE, COPYING, NOTICE) license their directory. A file without a licence of
its own takes that of its directory or else of the nearest directory above. Distinct directories are spread to their
ancestors and joined by path, so the work follows the number of directories, and a directory with a third of all files is
one row until the last join.

Everything is DataFrame functions: tokens, weights and scores are computed inside the row, without a shuffle. Only the
templates' frequencies (a row per template term) come to the driver.

Null and empty texts match nothing. A null path is a file of its own without directory. Rows are kept as they are.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import keep_table

# fixed values: the notices that licences ask for or that are in common use
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
# further short forms, headers and what licence files begin with; found anywhere in a text, over line ends
NOTICES = [
    *TEMPLATES.items(),
    *[(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in CC],
    *[(f"CC-{k}-4.0", f"licensed under a Creative Commons {name} 4.0 International License.") for k, name in CC.items()],
    *[(k, f"SPDX-License-Identifier: {k}") for k in TEMPLATES],
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Licensed under the GPL v3"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)"
DIGITS = 6


def template_terms(text: str) -> dict[str, int]:
    found = re.findall("[a-z0-9]+", text.lower())
    return {t: found.count(t) for t in sorted(set(found))}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents and of those that hold each term."""
    one = docs.select(F.explode(F.array_append(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, terms))), "")).alias("term"))
    found = {r["term"]: r["n"] for r in one.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per template term
    return found.pop("", 0), found


def best_match(text: Column, weights: dict[str, float], unknown: float, templates: dict[str, dict[str, int]], min_cosine: float) -> Column:
    """``struct(score, name)`` of the best line and template, or null."""
    telling = set().union(*(telling_terms(terms, weights, min_cosine) for terms in templates.values()))
    pattern = r"(?<![a-z0-9])(?:" + "|".join(sorted(telling)) + r")(?![a-z0-9])"
    idf = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = lambda t: F.coalesce(F.try_element_at(idf, t), F.lit(unknown))

    def add(so_far: Column, t: Column) -> Column:
        again = so_far["last"] == t
        run = F.when(again, so_far["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), (so_far["sum"] + (2 * run - 1) * F.pow(weight(t), F.lit(2))).alias("sum"))

    def times(found: Column, term: str) -> Column:
        return F.size(F.filter(found, lambda x: x == term))

    def score(line: Column) -> Column:
        def of(found: Column) -> Column:
            start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
            size = F.sqrt(F.aggregate(F.array_sort(found), start, add, lambda x: x["sum"]))
            each = []
            for name, terms in templates.items():
                norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in terms.items()))
                parts = [times(found, t) * F.lit(n * weights[t] ** 2 / norm) for t, n in terms.items()]
                each.append(F.struct(F.round(reduce(Column.__add__, parts) / size, DIGITS).alias("score"), F.lit(name).alias("name")))
            return F.array_max(F.array(*each))

        return F.element_at(F.transform(F.array(tokens(line)), of), 1)

    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(pattern))
    best = F.array_max(F.transform(lines, score))
    return F.when(F.lower(text).rlike(pattern) & (best["score"] >= min_cosine), best)


def telling_terms(terms: dict[str, int], weights: dict[str, float], min_cosine: float) -> set[str]:
    """Terms of which a text must share one to reach ``min_cosine``."""
    squares = sorted(((n * weights[t]) ** 2, t) for t, n in terms.items())
    total, light, telling = sum(s for s, _ in squares), 0.0, set()
    for square, term in squares:
        light += square
        if light >= (min_cosine**2 - 1e-9) * total:
            telling.add(term)
    return telling


def best_window(text: Column, weights: dict[str, float], unknown: float, notices: list[tuple[str, str]], min_cosine: float) -> Column:
    """``struct(score, name)`` of the best notice and window of as many words, wherever the window lies, or null."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    counted = [(name, re.findall("[a-z0-9]+", notice.lower()), template_terms(notice)) for name, notice in notices]
    telling = [telling_terms(terms, weights, min_cosine) for _, _, terms in counted]
    every = sorted(set().union(*telling))

    def add(so_far: Column, t: Column) -> Column:
        run = F.when(so_far["last"] == t, so_far["run"] + 1).otherwise(F.lit(1))
        square = F.pow(F.coalesce(F.try_element_at(known, t), F.lit(unknown)), F.lit(2))
        return F.struct(t.alias("last"), run.alias("run"), (so_far["sum"] + (2 * run - 1) * square).alias("sum"))

    def of(found: Column) -> Column:
        places = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: x["t"].isin(every))
        return F.array_max(F.transform(F.array(places), lambda hits: F.array_max(F.array(*[one(found, hits, *c, t) for c, t in zip(counted, telling)])))) if counted else F.lit(None)

    def one(found: Column, hits: Column, name: str, order: list[str], terms: dict[str, int], own: set[str]) -> Column:
        norm, size = math.sqrt(sum((n * weights[t]) ** 2 for t, n in terms.items())), len(order)
        offsets = F.create_map(*[x for t in sorted(own) for x in (F.lit(t), F.array(*[F.lit(k) for k, o in enumerate(order) if o == t]))])
        parts = F.create_map(*[F.lit(x) for t, n in terms.items() for x in (t, n * weights[t] ** 2 / norm)])
        latest = F.greatest(F.size(found) - size, F.lit(0))
        mine = F.filter(hits, lambda x: x["t"].isin(sorted(own)))
        starts = F.array_distinct(F.flatten(F.transform(mine, lambda x: F.transform(F.try_element_at(offsets, x["t"]), lambda k: F.least(F.greatest(x["i"] - k, F.lit(0)), latest)))))
        windows = F.array_distinct(F.transform(starts, lambda k: F.array_sort(F.slice(found, k + 1, size))))

        def score(window: Column) -> Column:
            start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
            length = F.sqrt(F.aggregate(window, start, add, lambda x: x["sum"]))
            shared = F.aggregate(window, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(parts, t), F.lit(0.0)))
            return F.round(shared / length, DIGITS)

        return F.struct(F.array_max(F.transform(windows, score)).alias("score"), F.lit(name).alias("name"))

    pattern = r"(?<![a-z0-9])(?:" + "|".join(every) + r")(?![a-z0-9])"
    best = F.element_at(F.transform(F.array(tokens(text)), of), 1)
    found = F.when(F.lower(text).rlike(pattern), best)
    return F.when(found["score"] >= min_cosine, found)


def scan_licences(
    df: DataFrame, templates: dict[str, str] = TEMPLATES, min_cosine: float = 0.6, notices: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
) -> DataFrame:
    """``id_col, path_col, own_licence, score, licence, licence_dir``.

    ``notices`` go with the default ``templates``, unless given; templates are compared as notices too.
    ``licence`` is the file's own or the inherited one; ``licence_dir`` the directory that it is inherited from.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    counted = {name: template_terms(t) for name, t in sorted(templates.items())}
    more = notices if notices is not None else NOTICES if templates is TEMPLATES else []
    notices = list(dict.fromkeys([*templates.items(), *more]))
    terms = sorted({t for c in counted.values() for t in c} | {t for _, notice in notices for t in template_terms(notice)})
    rows, found = frequencies(docs.select("text"), terms)
    weights = {t: math.log((rows + 1) / (found.get(t, 0) + 1)) + 1 for t in terms}
    line = best_match(F.col("text"), {t: weights[t] for t in sorted({t for c in counted.values() for t in c})}, math.log(rows + 1) + 1, counted, min_cosine)
    docs = docs.withColumn("line", line)
    window = F.when(F.col("line.score").isNull() | (F.col("line.score") < 1), best_window(F.col("text"), weights, math.log(rows + 1) + 1, notices, min_cosine))
    match = F.when(F.col("line.score") >= window["score"], F.col("line")).otherwise(F.coalesce(window, F.col("line")))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    seen = keep_table(docs.select("id", "path", folder.alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("file"), match.alias("m")), "licence-matches")

    ruled = seen.filter(F.col("file").rlike(LICENCE_FILE) & F.col("m").isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.max("m").alias("given"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))
    dirs = seen.select("dir").filter("dir is not null").distinct().select("dir", F.explode(F.array_distinct(F.array_append(above, ""))).alias("above"))
    nearest = dirs.join(ruled, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", F.col("given.name").alias("name"))).alias("from"))
    own = F.col("m.name")
    return seen.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), own.alias("own_licence"), F.col("m.score").alias("score"),
        F.coalesce(own, F.col("from.name")).alias("licence"), F.when(own.isNull(), F.col("from.above")).alias("licence_dir"),
    )


def repository_path() -> Column:
    """Documents have no path; this derives one: source, language and hundreds of the id are directories, and short texts that speak of a license are licence files, every other one a level higher."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    leaf = F.concat_ws("/", top, F.floor(F.col("doc_id") / 100).cast("string"))
    short = F.coalesce((F.length("text") < 2000) & F.lower("text").contains("license"), F.lit(False))
    name = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.when(short & (F.col("doc_id") % 2 == 0), top).otherwise(leaf), name)


def licence_sql(templates: dict[str, str] = TEMPLATES, min_cosine: float = 0.6) -> str:
    rows = ", ".join(f"('{name}', '{term}', {n})" for name, text in sorted(templates.items()) for term, n in template_terms(text).items())
    return f"""
WITH templates(name, term, n) AS (VALUES {rows}),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none')) AS top,
         coalesce(length(text) < 2000 AND contains(lower(text), 'license'), false) AS short
  FROM documents
), paths AS (
  SELECT doc_id, text, CASE WHEN short AND doc_id % 2 = 0 THEN top ELSE top || '/' || (doc_id // 100)::VARCHAR END AS dir,
         CASE WHEN short THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS file
  FROM docs
), size AS (SELECT count(*) AS n FROM docs),
df AS (
  SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM docs)
  WHERE term IN (SELECT term FROM templates) GROUP BY term
), idf AS (
  SELECT t.term, ln((size.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS w
  FROM (SELECT DISTINCT term FROM templates) t CROSS JOIN size LEFT JOIN df ON df.term = t.term
), norms AS (SELECT name, sqrt(sum((n * w) ^ 2)) AS norm FROM templates JOIN idf USING (term) GROUP BY name),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
counts AS (
  SELECT doc_id, k, term, count(*) AS n
  FROM (SELECT doc_id, k, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) AS term FROM lines) WHERE term <> '' GROUP BY ALL
), sizes AS (
  SELECT doc_id, k, sqrt(sum((c.n * coalesce(idf.w, ln(size.n + 1) + 1)) ^ 2)) AS norm
  FROM counts c CROSS JOIN size LEFT JOIN idf USING (term) GROUP BY doc_id, k
), scores AS (
  SELECT c.doc_id, c.k, t.name, round(sum(c.n * t.n * idf.w ^ 2) / any_value(norms.norm) / any_value(sizes.norm), {DIGITS}) AS score
  FROM counts c JOIN templates t USING (term) JOIN idf USING (term) JOIN norms USING (name) JOIN sizes ON sizes.doc_id = c.doc_id AND sizes.k = c.k
  GROUP BY c.doc_id, c.k, t.name
), own AS (
  SELECT doc_id, name, score FROM scores WHERE score >= {min_cosine}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name DESC) = 1
), ruled AS (
  SELECT dir, name FROM paths JOIN own USING (doc_id) WHERE file LIKE 'LICENSE%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name DESC) = 1
), nearest AS (
  SELECT d.dir, r.dir AS above, r.name FROM (SELECT DISTINCT dir FROM paths) d JOIN ruled r ON d.dir = r.dir OR starts_with(d.dir, r.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(r.dir) DESC) = 1
)
SELECT p.doc_id, p.dir || '/' || p.file AS path, own.name AS own_licence, own.score, coalesce(own.name, nearest.name) AS licence,
       CASE WHEN own.name IS NULL THEN nearest.above END AS licence_dir
FROM paths p LEFT JOIN own USING (doc_id) LEFT JOIN nearest ON nearest.dir = p.dir
"""
