"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of ceil(|T| / t) words of a text, over line ends too, for a template
T of |T| words and threshold t; so a notice wrapped at any width is found. A block
matches T if it holds at least need = ceil(t n) of T's n distinct tokens. The join finds
every match:

* Tokens of the templates stand in one global order, rarest in the corpus first. A block
  that matches T holds one of the first n - need + 1 tokens of T in this order, so only
  these are indexed (prefix filter): texts without one are left at the first scan, the
  others join the index by token, which gives pairs of text and template.
* Of each pair the places of T's tokens are gathered. The block at a place must hold
  `need` places (length filter), and its first token in the global order bounds what
  can follow it on either side (positional filter).
* What remains is verified by the exact overlap.

Everything is DataFrame functions. The index has a row for each token of each template;
it is broadcast up to `MOST_BROADCAST` rows and joined by a shuffle beyond, so templates
may be many. Texts are not shuffled; places of template tokens in likely texts are."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, cut, table, words_column

THRESHOLD = 0.8
MOST_BROADCAST = 200_000
#: Phrases whose words must follow one another, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings and notices of public licenses, by label.
TEMPLATES = {
    "agpl-3.0": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-notice": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl": "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "mit-notice": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "proprietary": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
_SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLOCKS = "array<struct<word:int,label:string,part:double>>"


def tokens(text: str) -> list[str]:
    """Words of a template, as `words_column` takes them from a text."""
    return [w for w in _SPLIT.split(text.translate(str.maketrans(UPPER, LOWER))) if w]


def need_of(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def window_of(n_words: int, threshold: float) -> int:
    return math.ceil(n_words / threshold - 1e-9)


def _literal(words: list[str]) -> Column:
    """One array literal, whatever its length; words hold no space."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def _ordered(words: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' tokens, rarest first by the number of texts that hold them; at most one row for each comes back."""
    vocabulary = sorted({w for t in templates.values() for w in tokens(t)})
    present = F.array_intersect(F.col("_words"), _literal(vocabulary))
    count = {r["w"]: r["count"] for r in words.select(F.explode(present).alias("w")).groupBy("w").count().collect()} if vocabulary else {}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places where a phrase's words stand one after the other;
    first_word and last_word are the smallest and largest start. blocks has, for each
    template and in the order of the text, matches that don't overlap: the number of the
    word with which the block begins, the label and the part of the template's tokens it
    holds; of blocks that overlap the fullest stays, of equal ones the first. score is the
    largest part, 1 where a phrase stands, else 0. A null text is empty; empty texts have
    no words and empty labels; repeated rows are scanned each, an empty table gives no
    rows. Texts are taken whole. Only the two named columns are read."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    templates = {label: text for label, text in templates.items() if tokens(text)}
    spark = docs.sparkSession
    wide = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), words_column(F.col(text_col)).alias("_words"))
    order = {w: k for k, w in enumerate(_ordered(wide, templates))}
    index, about, seeds = [], [], set()
    for label, text in templates.items():
        ranked = sorted(set(tokens(text)), key=order.get)
        need = need_of(len(ranked), threshold)
        about.append((label, len(ranked), need, window_of(len(tokens(text)), threshold)))
        index += [(w, label, k + 1, k < len(ranked) - need + 1) for k, w in enumerate(ranked)]
        seeds.update(ranked[: len(ranked) - need + 1])

    starts = sorted({tokens(p)[-1] for p in phrases if tokens(p)})
    # Phrases: only texts that hold a phrase's last word anywhere can hold the phrase.
    may = F.arrays_overlap("_words", _literal(starts)) if starts else F.lit(False)
    places = [_places(tokens(phrase), label) for phrase, label in phrases.items() if tokens(phrase)]
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    found = F.when(may & (F.size("_words") > 0), F.concat(*places)).otherwise(none) if places else none
    # Blocks: only texts that hold a token of some template's prefix can hold one.
    likely = F.when(F.arrays_overlap("_words", _literal(sorted(seeds))), F.col("_text")) if seeds else F.lit(None).cast("string")
    base = wide.select("_id", F.size("_words").cast("bigint").alias("n_words"), found.alias("_found"), likely.alias("_likely"))
    # numbered in the checkpoint, where rows have their places for good
    base = cut(base).withColumn("_key", F.monotonically_increasing_id())
    if templates:
        blocks = _blocks(spark, base.where("_likely is not null").select("_key", "_likely"), index, about)
        base = base.drop("_likely").join(blocks, "_key", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(_BLOCKS)))
    else:
        base = base.withColumn("blocks", F.array().cast(_BLOCKS))
    at = F.transform("_found", lambda x: x["at"])
    labels = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["label"])))
    more = F.transform("blocks", lambda x: x["label"])
    part = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["part"])), F.lit(0.0))
    return base.select(
        F.col("_id").alias(id_col), "n_words", F.size("_found").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, more)), ",").alias("labels"),
        F.when(F.size("_found") > 0, F.lit(1.0)).otherwise(part).alias("score"), "blocks",
    )


def _blocks(spark: SparkSession, likely: DataFrame, index: list[tuple[str, str, int, bool]], about: list[tuple[str, int, int, int]]) -> DataFrame:
    """(_key, blocks) of the texts `likely` (_key, _likely) that match a template."""
    postings = spark.createDataFrame(index, "token string, label string, rank int, prefix boolean")
    sizes = spark.createDataFrame(about, "label string, n int, need int, span int")
    vocabulary = postings.select("token").distinct()
    words = likely.select("_key", F.posexplode(words_column(F.col("_likely"))).alias("pos", "token"))
    hits = cut(words.join(_near(vocabulary, len(index)), "token", "left_semi"))
    # prefix filter: pairs of a text and a template that share a token of the template's prefix
    pairs = hits.join(_near(postings.where("prefix").select("token", "label"), len(index)), "token").select("_key", "label").distinct()
    # all places of the template's tokens in the texts of these pairs
    own = pairs.join(hits, "_key").join(_near(postings.select("token", "label", "rank"), len(index)), ["token", "label"])
    placed = own.groupBy("_key", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("at"), F.size(F.collect_set("rank")).alias("held"))
    placed = placed.join(_near(sizes, len(about)), "label").where("held >= need")

    def best(k: Column) -> Column:
        """How many distinct tokens the block holds that begins at the k-th place; null if a filter drops it."""
        begin = F.get("at", k)["pos"]
        inside = F.filter(F.slice("at", k + 1, F.col("span")), lambda x: x["pos"] < begin + F.col("span"))
        long_enough = F.get("at", k + F.col("need") - 1)["pos"] < begin + F.col("span")
        first = F.array_min(F.transform(inside, lambda x: x["rank"]))
        most = F.least(F.col("n") - first, F.size(inside) - 1) + 1
        held = F.size(F.array_distinct(F.transform(inside, lambda x: x["rank"])))
        return F.when(long_enough, F.when(most >= F.col("need"), F.when(held >= F.col("need"), held)))

    begins = F.sequence(F.lit(0), F.size("at") - F.col("need"))
    each = F.transform(begins, lambda k: F.struct(F.get("at", k)["pos"].alias("word"), best(k).alias("held")))
    full = F.filter(each, lambda x: x["held"].isNotNull())

    def apart(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        fuller = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))
        clear = last.isNull() | (x["word"] >= last["word"] + F.col("span"))
        return F.when(clear, F.concat(kept, F.array(x))).when(x["held"] > last["held"], fuller).otherwise(kept)

    matched = placed.withColumn("full", full).where(F.size("full") > 0)
    chosen = F.aggregate("full", F.array().cast("array<struct<word:int,held:int>>"), apart)
    listed = F.transform(chosen, lambda x: F.struct(x["word"].alias("word"), F.col("label").alias("label"), (x["held"] / F.col("n").cast("double")).alias("part")))
    return matched.select("_key", F.explode(listed).alias("b")).groupBy("_key").agg(F.array_sort(F.collect_list("b")).alias("blocks"))


def _places(ws: list[str], label: str) -> Column:
    """array<struct<at, label>> of the places in `_words` where the words `ws` stand one after the other."""
    span = F.sequence(F.lit(0), F.size("_words") - 1)
    found = F.filter(span, lambda i: _all(F.get("_words", i + k) == F.lit(w) for k, w in enumerate(ws)))
    return F.transform(found, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan` of every row of `documents` by the registered phrases and templates, without its blocks; nulls, repeats and empty tables as there."""
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def oracle_sql() -> str:
    """DuckDB SQL for `op2_license_scan`: every block that begins with a template's token against every template, without filters."""
    word = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {word}), lambda w: w <> '')"
    n = "len(words)"
    starts = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(tokens(phrase)))
        starts.append(f"list_transform(list_filter(range({n}), lambda i: {test}), lambda i: {{'at': i, 'label': '{label}'}})")
    values = ", ".join(f"('{label}', {sorted(set(tokens(t)))!r}, {window_of(len(tokens(t)), THRESHOLD)})" for label, t in TEMPLATES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
f AS (SELECT r, doc_id, {n} AS n_words, list_concat(list_concat({starts[0]}, {starts[1]}), {starts[2]}) AS found FROM d),
t(label, ws, span) AS (VALUES {values}),
p AS (SELECT label, unnest(ws) AS w, len(ws) AS n, span FROM t),
h AS MATERIALIZED (SELECT r, i, label, p.w, n, span FROM (SELECT r, unnest(range({n})) AS i, unnest(words) AS w FROM d) JOIN p USING (w)),
b AS (SELECT a.r, a.label, count(DISTINCT b.w) / a.n::DOUBLE AS part FROM h a JOIN h b ON a.r = b.r AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.span
      GROUP BY a.r, a.label, a.i, a.n HAVING count(DISTINCT b.w) >= ceil({THRESHOLD} * a.n - 1e-9)),
m AS (SELECT r, list(DISTINCT label) AS more, max(part) AS part FROM b GROUP BY r)
SELECT doc_id, n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.at)) AS first_word,
  list_max(list_transform(found, lambda x: x.at)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(found, lambda x: x.label), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM f LEFT JOIN m USING (r)"""
