"""Operator 3: licence scan by Dice coefficient over word bigrams.

Every line of a text, and the whole text if it has several, is a segment.
Segments and templates are normalised alike (ASCII letters to lower case,
every run of other characters than a-z and 0-9 to one space) and compared by
``2 |A n B| / (|A| + |B|)`` over their sets of word bigrams.  A segment can only
reach the threshold t for templates with ``|A| t / (2 - t) <= |B| <= |A| (2 - t) / t``;
segments out of all templates' bounds, or without any template's bigram, are pruned
before any coefficient is computed.

DataFrame functions only.  Templates are a fixed table (a parameter), so they
enter the plan as literals: no join, no shuffle; one row per match, the best
template of a segment, ties by name.  Null and empty texts, and segments
of fewer than two words, match nothing.  Repeated rows match as often as they
occur; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of licence notices.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                         "file except in compliance with the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are "
                    "permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                  "and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in sorted(templates.items()):
        w = _words(text)
        out[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        if not out[name]:
            raise ValueError(f"template {name} has fewer than two words")
    return out


def _bigrams(normal: Column) -> Column:
    """Distinct word bigrams.  The words are bound to a lambda variable: a filter
    pushed below would otherwise split the text again for every word."""
    def of(w):
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2),
                            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(normal, " ")), of), 0)


def _may_match(text: Column, grams: dict[str, list[str]], threshold: float) -> Column:
    """A cheap condition that every matching text meets.  A match shares at
    least ``t / (2 - t)`` of a template's n bigrams, so it holds one of any n - that
    many + 1 of them: those with the longest words, by that word alone if it is long."""
    text = F.lower(text)
    words, pairs = set(), set()
    for g in grams.values():
        least = max(1, math.ceil(len(g) * threshold / (2 - threshold) - 1e-9))
        ranked = sorted(g, key=lambda x: (-max(map(len, x.split(" "))), x))
        for x in ranked[:len(g) - least + 1]:
            longest = max(x.split(" "), key=lambda w: (len(w), w))
            if len(longest) > 4:
                words.add(longest)
            else:
                pairs.add(x.replace(" ", "[^a-z0-9]+"))
    words = {w for w in words if not any(v != w and v in w for v in words)}
    tests = [F.contains(text, F.lit(w)) for w in sorted(words)]
    if pairs:
        tests.append(text.rlike("|".join(sorted(pairs))))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, licence, dice): segments that match a template; segment 0
    is the whole text, the others its lines from 1 on."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    ratio = (2 - threshold) / threshold
    low = min(len(g) for g in grams.values()) / ratio - 1e-6
    high = max(len(g) for g in grams.values()) * ratio + 1e-6
    any_gram = F.array(*[F.lit(g) for g in sorted({g for v in grams.values() for g in v})])
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    raw = raw.where(_may_match(F.col("text"), grams, threshold))
    lines = F.split("text", "\n", -1)
    segments = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(
        F.concat(F.array(F.lit("")), lines))
    one = raw.select("id", F.posexplode(segments).alias("segment", "raw"))
    one = one.where(_may_match(F.col("raw"), grams, threshold))
    normal = F.trim(F.regexp_replace(F.translate("raw", _UPPER, _LOWER), "[^a-z0-9]+", " "))
    one = one.select("id", "segment", _bigrams(normal).alias("g"))
    one = one.where(F.size("g").between(low, high) & F.arrays_overlap("g", any_gram))
    scores = []
    for name, g in grams.items():
        lit = F.array(*[F.lit(x) for x in g])
        dice = 2.0 * F.size(F.array_intersect("g", lit)) / (F.size("g") + F.lit(len(g)))
        fits = F.size("g").between(len(g) / ratio - 1e-6, len(g) * ratio + 1e-6)
        scores.append(F.when(fits, F.struct((-dice).alias("less"), F.lit(name).alias("licence"))))
    best = F.array_min(F.filter(F.array(*scores), lambda s: s.isNotNull()))
    return (one.withColumn("best", best).where(-F.col("best.less") >= threshold)
            .select(F.col("id").alias(id_col), "segment", F.col("best.licence").alias("licence"),
                    F.round(-F.col("best.less"), 6).alias("dice")))


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The scan of ``documents`` in DuckDB SQL, by unnesting and joining bigrams."""
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    values = ", ".join(f"('{name}', '{g}')" for name, v in grams.items() for g in v)
    return f"""
WITH t(licence, gram) AS (VALUES {values}),
size AS (SELECT licence, count(*) AS n FROM t GROUP BY licence),
lines AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l
  FROM documents WHERE text IS NOT NULL),
segments AS (
  SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS segment, unnest(l) AS raw FROM lines
  UNION ALL SELECT r, doc_id, 0, text FROM lines WHERE len(l) > 1),
words AS (
  SELECT r, doc_id, segment, string_split(trim(regexp_replace(
    translate(raw, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM segments),
grams AS (
  SELECT DISTINCT r, doc_id, segment, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
  FROM words WHERE len(w) > 1),
own AS (SELECT r, segment, count(*) AS n FROM grams GROUP BY ALL),
hits AS (SELECT r, doc_id, segment, licence, count(*) AS common FROM grams JOIN t USING (gram) GROUP BY ALL),
scored AS (
  SELECT r, doc_id, segment, licence, 2.0::DOUBLE * common / (own.n + size.n) AS dice
  FROM hits JOIN own USING (r, segment) JOIN size USING (licence)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY r, segment ORDER BY dice DESC, licence) AS k
  FROM scored WHERE dice >= {threshold})
SELECT doc_id, CAST(segment AS INTEGER) AS segment, licence, round(dice, 6) AS dice FROM best WHERE k = 1
"""
