"""License scan: an exact set-similarity join between blocks of texts and license notices.

A template is a notice with the words that name its license (`must`) and those that name a sibling instead (`never`).
A block of a template is a run of consecutive words of a text, a fifth longer than the notice at most, that holds
all of `must` and none of `never`; line ends and comment marks are no words, so notices may be wrapped. Both sides
are sets of lower-cased words. A block meets the template when it holds at least ``threshold`` of its words
(containment). Words are ordered by their frequency over all texts, rarest first, which gives three exact filters:

* prefix: a block that shares ``need = ceil(threshold * m)`` of a template's m words holds one of the first
  ``m - need + 1`` of them, so only those words are join keys;
* length: where fewer than ``need`` template words stand in reach of such a word, no block around it can meet;
* positional: with the shared word at place i of those in reach and j of the template, both in the global order, at
  most ``1 + min(n - i, m - j)`` words can be shared beside the ``min(i, j)`` rarer ones.

What is left is verified block by block. The template side is a fixed list, so it is broadcast.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, column, count_words, load, text_or_empty, words_of


class Template(NamedTuple):
    label: str
    notice: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


#: Words of the siblings of GPL and of the Creative Commons licenses.
_GNU = ("affero", "lesser", "library")
_CC = ("noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs", "derivatives")
#: Labels, the notices that stand for them, and the words that tell them from their siblings.
TEMPLATES = [
    Template("agpl-3", "This program is licensed under the GNU Affero General Public License, version 3.", ("affero",)),
    Template("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("bsd", "Released under the BSD 3-Clause License.", ("bsd",)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution"), _CC),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc", "by"), ("nc", "nd", "sa")),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "noncommercial"), _CC[2:]),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc"), ("nd", "sa")),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by", "nc", "sa")),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc", "by", "nd"), ("nc", "sa")),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "sharealike"), _CC[:2] + _CC[4:]),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa"), ("nc", "nd")),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse",)),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "2"), (*_GNU, "3")),
    Template("gpl-2", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.", ("gnu", "2"), (*_GNU, "3")),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "2"), (*_GNU, "3")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3"), (*_GNU, "2")),
    Template("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "3"), (*_GNU, "2")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("lgpl-3", "This library is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "3")),
    Template("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("lesser", "3")),
    Template("mit", "Released under the MIT License.", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
]
#: Phrases of the base columns and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: How much longer than the notice a block may be.
LONGER = 0.2
_SCALE = 1 << 20


def _phrase_pattern(phrase: str) -> str:
    inside = WORD.removesuffix("+")
    return rf"(?i)(?<!{inside})" + GAP.join(phrase.split()) + rf"(?!{inside})"


def notice_words(notice: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in notice))


def template_words(templates: list[Template]) -> list[list[str]]:
    return [sorted(set(notice_words(t.notice))) for t in templates]


def block_sizes(templates: list[Template]) -> list[int]:
    """Words that a block may hold, repeats counted."""
    return [(n := len(notice_words(t.notice))) + int(n * LONGER) for t in templates]


def word_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Over all rows of `texts` (column __text): in how many each template word stands. As many rows as template words."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col("__text")))
    return dict(map(tuple, texts.select(F.explode(held).alias("w")).groupBy("w").count().collect()))


def template_index(templates: list[Template], order: list[str], threshold: float) -> list[tuple]:
    """(template, label, word, place, m, need, size, words, must, never) for each word of each template's prefix."""
    at, sizes, out = {w: i for i, w in enumerate(order)}, block_sizes(templates), []
    for k, (t, words) in enumerate(zip(templates, template_words(templates), strict=True)):
        ranked = sorted(words, key=at.__getitem__)
        need = max(1, math.ceil(threshold * len(ranked) - 1e-9))
        out += [(k, t.label, w, j, len(ranked), need, sizes[k], ranked, list(t.must), list(t.never)) for j, w in enumerate(ranked[: len(ranked) - need + 1])]
    return out


_INDEX = "template int, label string, word string, j int, m int, need int, size int, words array<string>, must array<string>, never array<string>"


def _candidates(texts: DataFrame, order: list[str], index: list[tuple]) -> DataFrame:
    """(__id, __hash, index columns, from, near): places of prefix words around which a block may meet the template."""
    keys, reach = sorted({row[2] for row in index}), max(row[6] for row in index)
    small = texts.sparkSession.createDataFrame(index, _INDEX)
    rows = texts.select("__id", F.xxhash64("__text").alias("__hash"), F.array_remove(words_of(F.col("__text")), "").alias("tokens"))
    rows = rows.where(F.arrays_overlap("tokens", F.array(*map(F.lit, keys))))
    # rows of one text only: what stands around a prefix word, in reach of the longest block
    probes = rows.select("__id", "__hash", "tokens", F.posexplode("tokens").alias("p", "word")).where(F.col("word").isin(keys))
    first = F.greatest(F.col("p") - (reach - 1), F.lit(0))
    probes = probes.select("__id", "__hash", "word", "p", first.alias("first"), F.slice("tokens", first + 1, F.col("p") - first + reach).alias("around"))
    # a word outside of all templates can't be shared: the others in reach, rarest first
    probes = probes.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), F.col("around")))
    probes = probes.withColumns({"n": F.size("held"), "i": F.array_position("held", F.col("word")).cast("int") - 1})
    bound = F.lit(1) + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) + F.least("i", "j")
    joined = probes.join(F.broadcast(small), "word").where((F.col("n") >= F.col("need")) & (bound >= F.col("need")))
    begin = F.greatest(F.col("p") - F.col("size") + 1, F.lit(0))
    joined = joined.withColumn("from", begin).withColumn("near", F.slice("around", F.col("from") - F.col("first") + 1, F.col("p") - F.col("from") + F.col("size")))
    enough = (F.size(F.array_intersect("near", "words")) >= F.col("need")) & (F.size(F.array_except("must", "near")) == 0)
    return joined.where(enough).select("__id", "__hash", "template", "label", "m", "need", "size", "words", "must", "never", "from", "near")


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every run of blocks that meet a template: __id, __hash (xxhash64 of the text), template, label, word and last (first and last word, from 0), overlap, containment.

    Blocks of one template that begin less than a block's size apart are one run, with the largest overlap. Null and
    empty texts hold no block. Rows with the same id and text return the same runs once; rows with one id and
    different texts stay apart by their hash. Other columns of `docs` are ignored, whatever their names.
    """
    texts = docs.select(column(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    vocabulary = sorted({w for words in template_words(templates) for w in words})
    seen = word_frequencies(texts, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    found = _candidates(texts, order, template_index(templates, order, threshold))

    # the template's own words near the candidates, and its siblings' words, which no block crosses
    places = F.filter(F.transform("near", lambda w, k: F.struct((F.col("from") + k).alias("at"), w.alias("w"))), lambda x: F.array_contains("words", x["w"]) | F.array_contains("never", x["w"]))
    key = ["__id", "__hash", "template"]
    hits = found.select(*key, F.explode(places).alias("x")).select(*key, "x.at", "x.w").distinct()
    fixed = texts.sparkSession.createDataFrame(
        [(k, t.label, len(w), max(1, math.ceil(threshold * len(w) - 1e-9)), s, list(t.must), list(t.never)) for k, (t, w, s) in enumerate(zip(templates, template_words(templates), block_sizes(templates), strict=True))],
        "template int, label string, m int, need int, size int, must array<string>, never array<string>",
    )
    hits = hits.join(F.broadcast(fixed), "template").withColumn("other", F.array_contains("never", F.col("w")).cast("int"))
    per = Window.partitionBy(*key).orderBy("at")
    hits = hits.withColumn("part", F.sum("other").over(per.rowsBetween(Window.unboundedPreceding, 0))).where("other = 0")
    # places are scaled by the size, so that one frame, just under _SCALE wide, is a block of any template
    scaled, wide = F.floor(F.col("at").cast("long") * F.lit(_SCALE) / F.col("size")), _SCALE - _SCALE // (2 * max(block_sizes(templates)))
    frame = Window.partitionBy(*key, "part").orderBy(scaled).rangeBetween(Window.currentRow, wide)
    blocks = hits.withColumns({"set": F.collect_set("w").over(frame), "last": F.max("at").over(frame)}).withColumn("overlap", F.size("set"))
    blocks = blocks.where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("must", "set")) == 0))
    blocks = blocks.withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(per) >= F.col("size"), F.lit(True)).cast("int"))
    blocks = blocks.withColumn("run", F.sum("opens").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    runs = blocks.groupBy(*key, "label", "m", "run").agg(F.min("at").alias("word"), F.max("last").alias("last"), F.max("overlap").alias("overlap"))
    return runs.select(*key, "label", "word", "last", "overlap", (F.col("overlap") / F.col("m")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs`: the phrases it holds and the notices that its blocks contain.

    Columns: the id, n_words, n_base (places of a phrase), first_word, last_word (smallest and largest start in
    words, else null), base_labels and labels (distinct, sorted, comma-joined), score (largest containment; 1
    with a phrase; else 0), n_blocks (runs of blocks, of all templates). Null texts count as empty; an empty table returns no rows.
    """
    text = F.col("__text")
    base = docs.select(column(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    patterns = [(label, _phrase_pattern(p)) for label, p in PHRASES]
    counts = [F.regexp_count(text, F.lit(p)) for _, p in patterns]
    any_phrase = text.rlike("(?i)under|apache|cc")
    base = base.select(
        "__id",
        "__text",
        F.xxhash64("__text").alias("__hash"),
        count_words(text, GAP).alias("n_words"),
        *[F.when(any_phrase, c).otherwise(F.lit(0)).alias(f"__n{k}") for k, c in enumerate(counts)],
    )

    firsts, lasts = [], []
    for k, (_, p) in enumerate(patterns):
        parts = F.split(F.col("__text"), p, -1)
        firsts.append(F.when(F.col(f"__n{k}") > 0, count_words(F.element_at(parts, 1), GAP)))
        lasts.append(F.when(F.col(f"__n{k}") > 0, F.col("n_words") - count_words(F.element_at(parts, -1), GAP) - len(PHRASES[k][1].split())))
    base = base.select(
        "__id",
        "__hash",
        "n_words",
        sum((F.col(f"__n{k}") for k in range(len(patterns))), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"__n{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(patterns)]))).alias("__base"),
    )
    blocks = license_blocks(docs, id_col, text_col, templates, threshold).groupBy(F.col("__id").alias("__bid"), F.col("__hash").alias("__bhash"))
    # labels of one text: at most as many as the templates
    blocks = blocks.agg(F.collect_set("label").alias("__more"), F.max("containment").alias("__best"), F.count("*").alias("__blocks"))
    joined = base.join(blocks, F.col("__id").eqNullSafe(F.col("__bid")) & (F.col("__hash") == F.col("__bhash")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "__base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(F.col("__base"), F.coalesce("__more", none)))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"),
        F.coalesce("__blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op1_license_scan(spark, sf_dir):
    return license_scan(load(spark, sf_dir, "documents"))
