"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Fixed values of the base scan: label and phrase.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: What stands between words: all of ASCII but letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, template text: notices as they stand in files and pages. A block holds a template when it has enough of its words.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
CONTAINMENT = 0.8
#: Templates are configuration, not data: their words are literals in the plan, up to this many.
MAX_TEMPLATE_WORDS = 20_000


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sorted({w for w in re.split(NOT_WORD, lowered) if w})


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def base_scan(s: Column) -> dict[str, Column]:
    """Figures of the fixed phrases; s: the words with single spaces between, before and after."""
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in PHRASES:
        first, *rest = phrase.split(" ")
        n = F.regexp_count(s, F.lit(f" {first}(?= {' '.join(rest)} )"))
        start = F.locate(f" {phrase} ", s)
        back = F.length(s) - F.locate(f" {phrase} "[::-1], F.reverse(s)) - len(phrase)
        counts.append(n.cast("long"))
        firsts.append(F.when(n > 0, _spaces(F.substring(s, F.lit(1), start)) - 1))
        lasts.append(F.when(n > 0, _spaces(F.substring(s, F.lit(1), back)) - 1))
        labels.append(F.when(n > 0, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return {
        "n_base": total, "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base_set": F.array_compact(F.array(*labels)),
    }


def _need(words: list[str], threshold: float) -> int:
    return max(1, math.ceil(threshold * len(words) - 1e-9))


def run_length(text: str) -> int:
    """Words of a run that is judged against a template: a quarter more than it has."""
    return math.ceil(1.25 * len([w for w in re.split(NOT_WORD, text) if w]))


def block_table(docs: DataFrame, templates, threshold: float, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row per document: row, doc_id, n_words, the base figures, words (those of any template, once each), and blocks.

    Blocks are there where the whole text has enough words of some template: pieces of twice the longest run, each
    from the middle of the one before, so that every run lies in one. A block has its words' numbers in the
    vocabulary, 0 for words that no template has. Line ends are word ends like others.
    """
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), NOT_WORD, " ")), F.lit(" "))
    known = _literals(vocabulary)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), s.alias("s"))
    n_words = F.when(F.col("s") == "  ", F.lit(0)).otherwise(_spaces(F.col("s")) - 1).cast("long")
    words = F.array_intersect(known, F.split(F.trim("s"), " "))
    t = t.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), *[c.alias(k) for k, c in base_scan(F.col("s")).items()], words.alias("words"), "s")
    enough = F.lit(False)
    for _, text in templates:
        own = template_words(text)
        enough = enough | (F.size(F.array_intersect(F.col("words"), _literals(own))) >= _need(own, threshold))
    places = F.when(enough, F.transform(F.split(F.trim("s"), " "), lambda w: F.array_position(known, w).cast("int")))
    t = t.withColumn("places", places).drop("s")
    step = max((run_length(text) for _, text in templates), default=1)
    starts = F.sequence(F.lit(1), F.size("places"), F.lit(step))
    return t.withColumn("blocks", F.when(F.col("places").isNotNull(), F.transform(starts, lambda i: F.slice("places", i, 2 * step)))).drop("places")


def block_matches(table: DataFrame, vocabulary: list[str], templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """row, template, label, containment: every template of which some run of words has at least threshold, exactly.

    Words are ordered from rare to frequent over all documents. A block that shares o of a template's t words has one
    of the template's t - o + 1 rarest, its prefix; blocks meet templates by equi-join on prefix words. The length
    filter (the block has o template words at all) and the positional filter (the words up to and after the shared
    one, on either side, must reach o) come before the exact intersection, and that before the runs of the block are
    intersected one by one. A run starts at a word of the template: one that starts elsewhere has no more of them.
    """
    spark = table.sparkSession
    counted = table.select(F.explode("words").alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counted.collect()}  # words of templates only
    at = {w: i for i, w in enumerate(vocabulary, 1)}
    order = lambda w: (frequency.get(w, 0), w)
    rows, least = [], None
    for t, (label, text) in enumerate(templates):
        words = sorted(template_words(text), key=order)
        need = _need(words, threshold)
        least = need if least is None else min(least, need)
        rows += [(t, label, [at[w] for w in words], need, run_length(text), at[word], pos) for pos, word in enumerate(words[: len(words) - need + 1])]
    prefixes = spark.createDataFrame(rows, "template int, label string, t_words array<int>, need int, length int, word int, pos int")
    numbers = lambda words: F.array(*[F.lit(at[w]) for w in words]) if words else F.array().cast("array<int>")
    ranked = numbers(sorted(vocabulary, key=order))
    prefix_words = F.array(*[F.lit(w) for w in sorted({r[5] for r in rows})]) if rows else F.array().cast("array<int>")
    blocks = table.select("row", F.posexplode("blocks").alias("block", "places"))
    found = blocks.where(F.arrays_overlap("places", prefix_words)).withColumn("b_words", F.array_intersect(ranked, F.col("places"))).where(F.size("b_words") >= (least or 1))
    exploded = found.select("row", "places", "b_words", F.posexplode("b_words").alias("b_pos", "word"))
    pairs = exploded.join(F.broadcast(prefixes), "word")  # as many rows as the templates' prefixes have words
    pairs = pairs.where("size(b_words) >= need and least(b_pos, pos) + 1 + least(size(b_words) - b_pos - 1, size(t_words) - pos - 1) >= need")
    pairs = pairs.where("size(array_intersect(b_words, t_words)) >= need")
    starts = "filter(transform(places, (x, i) -> if(array_contains(t_words, x), i + 1, 0)), i -> i > 0)"
    pairs = pairs.withColumn("overlap", F.expr(f"array_max(transform({starts}, i -> size(array_intersect(t_words, slice(places, i, length)))))")).where("overlap >= need")
    return pairs.groupBy("row", "template", "label").agg(F.max(F.col("overlap") / F.size("t_words")).alias("containment"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Base: places where a fixed phrase's words follow one another. The join adds labels of templates that a run of words
    holds, a quarter longer than the template at most, however lines are broken; score is the best containment
    found, 1 for a base phrase, 0 for nothing. n_blocks counts the templates that a block holds.
    Null and empty texts have no words: no labels ('' joined), score 0, null first_word and last_word. Each row
    stands for itself, so repeated rows and null ids are answered like others; empty tables give empty results;
    other columns are not read.
    """
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    table = written(block_table(docs, templates, threshold, vocabulary, id_col, text_col), "license_blocks")
    found = block_matches(table, vocabulary, templates, threshold)
    by_row = found.groupBy(F.col("row").alias("f_row")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count("*").alias("n_blocks"))
    out = table.drop("blocks", "words").join(by_row, F.col("row") == F.col("f_row"), "left")
    labels = F.array_sort(F.array_union("base_set", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle() -> str:
    """The same by brute force: every run of words against every template, every word position against every phrase."""
    templates = ", ".join(f"({i}, '{label}', {_sql_list(template_words(text))}, {run_length(text)})" for i, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS MATERIALIZED (SELECT r, i - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w) x,
     (VALUES {", ".join(f"('{label}', {_sql_list(p.split(' '))})" for label, p in PHRASES)}) v(label, words) WHERE x.w[i] = words[1] AND x.w[i : i + len(words) - 1] = words),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base_set FROM p GROUP BY r),
c AS MATERIALIZED (SELECT r, w, i, label, words, n FROM w, (VALUES {templates}) v(i, label, words, n) WHERE len(list_intersect(words, w)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
m AS (SELECT r, i, label, max(len(list_intersect(words, w[k : k + n - 1])) / len(words)::DOUBLE) AS containment FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM c) x
      WHERE len(list_intersect(words, w[k : k + n - 1])) >= ceil({CONTAINMENT} * len(words) - 1e-9) GROUP BY r, i, label),
f AS (SELECT r, list_distinct(list(label)) AS found, max(containment) AS best, count(*) AS n_blocks FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base_set, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(found, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0::DOUBLE)) AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""
