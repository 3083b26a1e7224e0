"""License notices in texts, by an exact set-similarity join with templates.

A text becomes an array of codes, one per word: the number of the word among
the words of all templates and phrases, 0 for any other. Text blocks are runs
of ``2 * s`` words that start at every multiple of ``s``, with s the next power
of two from a template's length, so that a notice of that length lies whole in
a block. A block matches a template if it holds at least ``percent`` per cent
of the template's distinct words.

The join: words are ordered by how often they occur in the corpus, rarest
first. Blocks around words of a template's prefix are the only candidates (a
block that misses the |T| - need + 1 rarest words of T can't hold ``need`` of
them). Their words, in the same order, meet the prefixes in a broadcast join;
a pair goes on if the block is long enough and if what is left behind the
common word on both sides can still reach ``need``; overlaps of these are
counted in full. Nothing is sampled or capped, and no text is shuffled.

The templates are a parameter and small: their words and prefixes are held by
the driver and by every task.

Defined results: null and empty texts have no words and no labels; long texts
are blocks like any other; repeated rows and rows with null or equal ids are
separate documents; equal tokens in frequency are ordered by the word; an empty
table gives an empty result. Columns of the input that are not named take no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize
from .terms import ALNUM, split_terms

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and their labels, as their authors word them (fixed values).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("all-rights-reserved", "All rights reserved"),
]


def words_of(text: str) -> list[str]:
    return split_terms(pa.array([text]), ALNUM)[0].to_pylist()


def _encoder(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            found, counts = split_terms(batch.column(batch.schema.get_field_index("text")), ALNUM)
            codes = pc.add(pc.fill_null(pc.index_in(found, value_set=known), -1), 1).cast(pa.int32())
            codes = pa.ListArray.from_arrays(pa.array([0, *counts.cumsum().tolist()], pa.int32()), codes)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), codes], names=["row", "codes"])
    return run


class Index:
    """Prefixes of the templates under one order of the words."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: list[str], counts: dict[int, int], percent: int):
        order = sorted(range(1, len(vocabulary) + 1), key=lambda c: (counts.get(c, 0), vocabulary[c - 1]))
        self.rank = [0] * (len(vocabulary) + 1)  # rank[code], from 1
        for r, c in enumerate(order):
            self.rank[c] = r + 1
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.rows, self.first = [], {}  # a row per word of a prefix; codes of prefixes by size of the blocks
        for t, (label, text) in enumerate(templates):
            ws = words_of(text)
            if not ws:
                continue
            size = ceil(log2(len(ws)))
            ranks = sorted({self.rank[code[w]] for w in ws})
            need = -(-len(ranks) * percent // 100)
            for i in range(len(ranks) - need + 1):
                self.rows.append((size, ranks[i], t, label, i, need, ranks))
                self.first.setdefault(size, []).append(order[ranks[i] - 1])

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "size int, rank int, template int, label string, i int, need int, ranks array<int>")


def encode(docs: DataFrame, keep: list[str], vocabulary: list[str]) -> DataFrame:
    """``(row, at, codes)``: the kept columns, a number of the row and its words' codes, written out."""
    taken = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([taken.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return materialize(map_batches(taken, _encoder(vocabulary), schema).withColumn("at", F.monotonically_increasing_id()), "license-codes")


def _places(phrase: list[int]) -> Column:
    """Where the words of a phrase stand consecutively (place of the first one)."""
    last = len(phrase) - 1

    def here(c: Column, i: Column) -> Column:
        whole = c == phrase[-1]
        for back in range(1, last + 1):
            whole = whole & F.coalesce(F.get("codes", i - back) == phrase[last - back], F.lit(False))
        return F.when(whole, i - last)

    found = F.array_compact(F.transform("codes", here))
    rare = F.lit(True)
    for c in set(phrase):
        rare = rare & F.array_contains("codes", c)
    return F.when(rare, found).otherwise(F.array().cast("array<int>"))


def _around(size: int, first: list[int]) -> Column:
    """The blocks of a size that hold a word of ``first``: size, start and codes."""
    places = F.array_compact(F.transform("codes", lambda c, i: F.when(c.isin(first), i)))
    here = F.transform(places, lambda p: F.floor(p / 2**size))
    here = F.array_distinct(F.concat(here, F.filter(F.transform(here, lambda b: b - 1), lambda b: b >= 0)))
    return F.transform(here, lambda b: F.struct(F.lit(size).alias("size"), (b * 2**size).alias("start"),
                                                F.slice("codes", (b * 2**size + 1).cast("int"), F.lit(2 << size)).alias("codes")))


def match(encoded: DataFrame, templates: list[tuple[str, str]], vocabulary: list[str], percent: int = 80) -> DataFrame:
    """``(at, template, label, first_word, last_word, containment)`` of every block that holds enough of a template."""
    spark = encoded.sparkSession
    seen = encoded.select(F.explode(F.filter("codes", lambda c: c > 0)).alias("c")).groupBy("c").count()
    index = Index(templates, vocabulary, {r["c"]: r["count"] for r in seen.collect()}, percent)  # a row per word of the templates at most
    if not index.rows:
        return spark.createDataFrame([], "at long, template int, label string, first_word long, last_word long, containment double")
    around = F.concat(*[_around(size, codes) for size, codes in sorted(index.first.items())])
    blocks = encoded.select("at", F.size("codes").alias("n"), F.explode(around).alias("b"))
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter("b.codes", lambda c: c > 0)), lambda c: F.get(F.array(*map(F.lit, index.rank)), c)))
    blocks = blocks.select("at", "n", "b.size", "b.start", ranked.alias("block"))
    block, left = F.size("block"), lambda i, n: n - F.col(i)
    pairs = blocks.select("*", F.posexplode("block").alias("j", "rank")).join(F.broadcast(index.frame(spark)), ["size", "rank"])
    pairs = pairs.filter((block >= F.col("need")) & (F.least(left("i", F.size("ranks")), left("j", block)) >= F.col("need")))
    shared = F.size(F.array_intersect("block", "ranks"))
    pairs = pairs.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
    end = F.least(F.col("start") + F.call_function("shiftleft", F.lit(2), F.col("size")), F.col("n"))
    return pairs.groupBy("at", "template", "label", F.col("start").alias("first_word"), (end - 1).cast("long").alias("last_word")).agg(
        F.max(F.col("shared") / F.size("ranks")).alias("containment"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] = PHRASES,
         templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """``(*keep, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)``, one row per document.

    ``matches`` holds the blocks: template, label, first and last word, and the
    share of the template's words in it. The score is 1 where a phrase stands,
    otherwise the largest such share.
    """
    vocabulary = sorted({w for text in [*phrases, *[t for _, t in templates]] for w in words_of(text)})
    code = {w: i + 1 for i, w in enumerate(vocabulary)}
    encoded = encode(docs, list(keep), vocabulary)
    places = [_places([code[w] for w in words_of(p)]) for p in phrases]
    named = [F.when(F.size(x) > 0, label) for x, label in zip(places, phrases.values())]
    base = encoded.select("row", "at", F.size("codes").cast("long").alias("n_words"), F.concat(F.array().cast("array<int>"), *places).alias("places"),
                          F.array_compact(F.array(F.lit(None).cast("string"), *named)).alias("named"))
    found = match(encoded, templates, vocabulary, percent).groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct("template", "label", "first_word", "last_word", "containment"))).alias("matches"))
    out = base.join(found, "at", "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    matches = F.coalesce("matches", F.array().cast(found.schema["matches"].dataType))
    out = out.withColumn("matches", matches)
    best = F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))
    return out.select("row.*", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
                      F.array_max("places").cast("long").alias("last_word"), listed(F.col("named")).alias("base_labels"),
                      listed(F.concat("named", F.col("matches.label"))).alias("labels"),
                      F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), "matches")


def oracle(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> str:
    """DuckDB SQL: every block against every template, without an index."""
    ps = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i FROM ahead WHERE " + " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(words_of(p)))
                            for p, label in phrases.items())
    aheads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(max(len(words_of(p)) for p in phrases)))
    ts = ", ".join(f"({n}, '{label}', [{', '.join(repr(w) for w in sorted(set(words_of(t))))}], {2 ** ceil(log2(len(words_of(t))))})"
                   for n, (label, t) in enumerate(templates))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
ahead AS (SELECT r, i, {aheads} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
base AS ({ps}),
places AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z FROM base GROUP BY r),
templates(id, label, t, step) AS (VALUES {ts}),
tokens AS (SELECT id, label, step, len(t) AS size, unnest(t) AS word FROM templates),
hits AS (SELECT r, id, label, size, word, i // step AS b FROM words JOIN tokens USING (word)
  UNION ALL SELECT r, id, label, size, word, i // step - 1 FROM words JOIN tokens USING (word) WHERE i >= step),
held AS (SELECT r, label, count(DISTINCT word) / size AS share FROM hits GROUP BY r, id, label, size, b HAVING 100 * count(DISTINCT word) >= {percent} * size),
marks AS (SELECT r, label, 1 AS base FROM base UNION ALL SELECT r, label, 0 FROM held),
named AS (SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM marks GROUP BY r),
best AS (SELECT r, max(share) AS share FROM held GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


ORACLE = oracle()
