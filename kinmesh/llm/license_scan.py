"""Licence scans by diagonal voting.  DataFrame functions only.

Every rolling word 3-gram of every document is hashed and joined with the positions of the templates' 3-grams; the
words are compared too, so a hit is exact.  A hit votes for its diagonal, the difference of its places in text and
template.  Diagonals at most ``drift`` apart merge, which bridges inserted and missing words; a merged span counts
if the template's 3-grams that it has are share enough.  A base phrase must be there in full, on one diagonal.

The templates are a constant of this module, so their broadcast has a fixed size.  Shuffled are one row for each
document and the hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences and notices, with the labels that the method adds.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]

K = 3
#: Word characters with capitals, which are lowered after the split; the Kelvin sign is not a k.
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_rows(base: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, is base, its 3-grams, place, three words) of each template 3-gram."""
    out = []
    for t, (label, text, is_base) in enumerate([*((v, k, True) for k, v in base.items()), *((a, b, False) for a, b in templates)]):
        w = text.split()
        n = len(w) - K + 1
        if n < 1:
            raise ValueError(f"a template needs {K} words: {text!r}")
        out += [(t, label, is_base, n, i, *w[i : i + K]) for i in range(n)]
    return out


def scan(
    docs: DataFrame, *, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES, drift: int = 2,
    least_share: float = 0.6,
) -> DataFrame:
    """A row for each row of docs: counts, labels, score and the spans (label, first word, end, share, is base).

    Null and empty texts have no words and no spans.  Equal rows (doc_id and text) come out alike.  Base spans
    that overlap count each.  score is the largest share of any template that was found, 1 for a base phrase.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(
        template_rows(base, templates), "t int, label string, is_base boolean, n int, at int, a string, b string, c string"
    )
    grams = grams.withColumn("hash", F.xxhash64("a", "b", "c"))
    mark = spark.createDataFrame([(None, None, None, None, None, "", "", "")], grams.drop("hash").schema).withColumn(
        "hash", F.xxhash64("a", "b", "c")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("é")))
    words = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"),
        F.array_remove(F.split(lowered, _SPLIT), "").alias("w"),
    )
    size = F.size("w")
    rolled = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, size).alias("b"), F.slice("w", 3, size).alias("c"))
    # the first row of each document, which meets `mark`, carries it through the join
    head = F.array(F.struct(*(F.lit("").alias(x) for x in "abc")))
    rows = words.select("id", "th", size.alias("n_words"), F.posexplode(F.concat(head, rolled)).alias("place", "g"))
    rows = rows.select("id", "th", "n_words", "place", "g.*").withColumn("hash", F.xxhash64("a", "b", "c"))
    hits = rows.join(F.broadcast(grams.union(mark)), ["hash", "a", "b", "c"])
    hits = stash(
        hits.select("id", "th", "n_words", (F.col("place") - 1).alias("place"), "t", "label", "is_base", "n", "at"), "license-hits"
    )
    key = ["id", "th"]
    times = hits.where("t is null").groupBy(*key, "n_words").agg(F.count("*").alias("times"))
    hits = hits.where("t is not null").drop("n_words").distinct().withColumn("diagonal", F.col("place") - F.col("at"))
    exact = hits.where("is_base").groupBy(*key, "t", "label", "n", "diagonal").agg(F.count("*").alias("votes"))
    exact = exact.where("votes = n").select(
        *key, "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n") + K - 1).alias("end"),
        F.lit(1.0).alias("share"), F.lit(True).alias("is_base"),
    )
    line = Window.partitionBy(*key, "t").orderBy("diagonal")
    far = hits.where("not is_base").withColumn("far", F.col("diagonal") - F.lag("diagonal").over(line) > drift)
    # rows of one diagonal are peers of the range, so they fall in one group
    merged = far.withColumn("g", F.sum(F.coalesce(F.col("far").cast("int"), F.lit(0))).over(line))
    spans = merged.groupBy(*key, "t", "label", "n", "g", "at").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    spans = spans.groupBy(*key, "t", "label", "n", "g").agg(
        F.count("*").alias("votes"), F.min("low").alias("first"), (F.max("high") + K).alias("end")
    )
    spans = spans.withColumn("share", F.col("votes") / F.col("n")).where(F.col("share") >= least_share)
    spans = exact.union(spans.select(*key, "label", "first", "end", "share", F.lit(False).alias("is_base")))
    found = spans.groupBy(*key).agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "end", "label", "share", "is_base"))).alias("spans"),
    )
    left, right = times.alias("x"), found.alias("y")
    met = left.join(right, F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.th") == F.col("y.th")), "left")
    met = met.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    none = F.array().cast("array<string>")
    return met.select(
        F.col("x.id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.coalesce("base_labels", none), ",").alias("base_labels"),
        F.array_join(F.coalesce("labels", none), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: licence labels of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The query in DuckDB's SQL."""
    rows = ", ".join(
        f"({t}, '{label}', {is_base}, {n}, {at}, '{' '.join(gram)}')" for t, label, is_base, n, at, *gram in template_rows(BASE, TEMPLATES)
    )
    return rf"""
WITH tpl(t, label, is_base, n, pos, gram) AS (VALUES {rows}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS place, w FROM docs WHERE len(w) >= 3),
hits AS (SELECT doc_id, place, t, label, is_base, n, pos, place - pos AS diagonal
         FROM (SELECT doc_id, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] AS gram FROM grams) JOIN tpl USING (gram)),
exact AS (SELECT doc_id, label, diagonal AS first, 1.0::DOUBLE AS share, true AS is_base FROM hits WHERE is_base
          GROUP BY doc_id, t, label, n, diagonal HAVING count(*) = n),
far AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) > 2)::INT, 0) AS f FROM hits WHERE NOT is_base),
merged AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS g FROM far),
spans AS (SELECT doc_id, label, min(place) AS first, count(DISTINCT pos)::DOUBLE / n AS share, false AS is_base FROM merged
          GROUP BY doc_id, t, label, n, g HAVING count(DISTINCT pos)::DOUBLE / n >= 0.6 UNION ALL SELECT * FROM exact),
found AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word,
          max(first) FILTER (is_base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
          string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL = _sql()
