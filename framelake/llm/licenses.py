"""License scans with DataFrame functions only.

Texts are lower-cased word shingles (SHINGLE words, hashed). Templates fall into classes by their number of shingles c;
texts are cut into windows of 2c shingles that overlap by c, so an occurrence over c places lies in one window. There its
Jaccard similarity to the template is 1 / 2 at least if it is whole, 0.8 / 2.2 > 0.36 if it holds the accepted share
CONTAINED. MinHash signatures with BANDS bands of one row retrieve templates: the probability that an occurrence collides
is at least 1 - 0.64 ** 32 > 0.999999. Shingles that are scattered over more places have no such bound. Candidates are
verified by exact containment of the template's shingles in the whole text.

A one-row band collides only on a shingle of the template itself, so of all windows only those that hold a shingle of
a template of their class are hashed: the others can't collide, and the result is that of hashing every window.

Edge cases: null and empty texts and texts of fewer words than a shingle match nothing; templates shorter than a
shingle are one shingle of all their words and need a text of these words alone; repeated rows with one id give one
row; null ids form one group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
#: After lower-casing: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: License names and phrases of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def word_hashes(text: Column) -> Column:
    """Hashes of all words of the whole text, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: a generator's output is not pulled into later expressions and filters."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds column ``sh``; the words' hashes are computed once, then combined."""
    df = _once(df, word_hashes(F.col(text)), "_w")
    n = F.size("_w") - (SHINGLE - 1)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(SHINGLE))))
    short = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    return _once(df, F.when(n > 0, grams).otherwise(short), "sh").drop("_w")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, t (distinct shingles), n, cls (n: windows are twice as long as the template)."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in sorted(templates.items()))))
    out = _shingles(spark.range(1).select(rows.alias("r")).select("r.*"), "body")
    out = out.withColumn("t", F.array_distinct("sh")).withColumn("n", F.size("t")).where("n > 0")
    return out.select("license", "t", "n", F.col("n").alias("cls"))


def _signature(shingles: Column) -> list[Column]:
    """Least hash of the shingles under each of BANDS hash functions."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(F.lit(k), x)))

    return [least(k) for k in range(BANDS)]


def _near(own: Column, c: int, members: list[int]) -> Column:
    """Windows of 2c shingles, overlapping by c, that hold one of ``members``; own: the text's template shingles (x, i)."""
    at = F.transform(F.filter(own, lambda o: o["x"].isin(members)), lambda o: F.floor(o["i"] / c).cast("int"))
    first = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda k: F.array(k, k - 1)))), lambda k: k >= 0)
    return F.transform(first, lambda k: F.struct(F.lit(c).alias("cls"), F.slice("sh", k * c + 1, F.lit(2 * c)).alias("win")))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_matched, n_shingles, containment for each template that a text holds.

    What leaves a row are windows around template shingles and the template shingles that the whole text has; work and
    memory are linear in the text.
    """
    table = template_table(spark, templates or TEMPLATES)
    known = table.select("t", "cls").collect()  # the templates: a parameter of the operator
    every = sorted({h for r in known for h in r.t})
    classes = {c: sorted({h for r in known if r.cls == c for h in r.t}) for c in sorted({r.cls for r in known})}
    texts = _shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").drop("text")
    marked = F.transform("sh", lambda x, i: F.when(x.isin(every), F.struct(x.alias("x"), i.alias("i"))))
    texts = _once(texts, F.filter(marked, lambda o: o.isNotNull()), "own").where(F.size("own") > 0)
    have = F.array_distinct(F.transform("own", lambda o: o["x"]))
    windows = F.flatten(F.array(*(_near(F.col("own"), c, members) for c, members in classes.items())))
    cut = texts.select("doc_id", have.alias("have"), F.explode(windows).alias("w"))
    bands = lambda signature: F.posexplode(F.array(*signature)).alias("band", "value")
    asked = cut.select("doc_id", "have", F.col("w.cls").alias("cls"), bands(_signature(F.col("w.win"))))
    held = table.select("license", "t", "n", "cls", bands(_signature(F.col("t"))))
    hits = asked.join(F.broadcast(held), ["cls", "band", "value"])  # BANDS rows a template
    matched = F.size(F.array_intersect("t", "have"))
    return (
        hits.select("doc_id", "license", "n", matched.alias("m"))
        .groupBy("doc_id", "license")
        .agg(F.max("m").cast("long").alias("n_matched"), F.max("n").cast("long").alias("n_shingles"))
        .withColumn("containment", F.round(F.col("n_matched") / F.col("n_shingles"), 6))
        .where(F.col("n_matched") >= F.lit(CONTAINED) * F.col("n_shingles"))
    )


def templates_in(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder on the driver: the file name is the license."""
    import pathlib

    return {p.name: p.read_text("utf-8", "replace") for p in sorted(pathlib.Path(folder).iterdir()) if p.is_file() and not p.is_symlink()}


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same result by comparing every text with every template."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted((templates or TEMPLATES).items()))
    grams = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    words = "regexp_extract_all(lower(coalesce({0}, '')), '" + WORD + "')"
    return f"""
WITH tpl AS (SELECT license, list_distinct({grams}) AS t FROM (SELECT license, {words.format('body')} AS w FROM (VALUES {rows}) v(license, body))),
txt AS (SELECT doc_id, {grams} AS s FROM (SELECT doc_id, {words.format('text')} AS w FROM documents)),
hit AS (SELECT doc_id, license, len(list_intersect(t, s)) AS m, len(t) AS n FROM txt, tpl WHERE list_has_any(s, t))
SELECT doc_id, license, max(m)::BIGINT AS n_matched, max(n)::BIGINT AS n_shingles, round(max(m) / max(n), 6) AS containment
FROM hit GROUP BY doc_id, license HAVING max(m) >= {CONTAINED} * max(n)"""
