"""License notices in documents: fixed phrases, and an exact set-similarity join with notice templates.

Columns only. A template of n words is found where some stretch of at most 2n consecutive words holds at least a given share of them,
whatever lines it is wrapped over and whatever stands between. Text blocks are windows of 3m words that start every m
words, m being the size of the largest template, so every such stretch lies in a block. The join is a prefix-filter join: template
words are ordered by how many documents hold them, rarest first; a block with enough of a template's words must hold
one of its first n - needed + 1 (prefix filter). Documents and blocks without any such word end there. The others are joined
with the prefix index by word; a pair goes on when the block has enough words (length filter) and enough of both sides is left
behind their first common word (positional filter), and is then counted exactly, stretch by stretch.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import col

#: Phrases of the base scan, in words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label. A label may have several.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY"),
    ("cc-by", "licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-nd", "Licensed under CC BY-ND"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution NoDerivatives License"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("cddl", "subject to the terms of the Common Development and Distribution License"),
    ("artistic", "you can redistribute it and or modify it under the terms of the Artistic License"),
    ("odbl", "made available under the Open Database License"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("bsl", "Use of this software is governed by the Business Source License"),
)

#: A stretch of words that may hold a template's words, as a multiple of their number.
STRETCH = 2

#: Word characters and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A sign whose lower case is an ASCII letter, and one that stays outside ASCII.
_KELVIN, _OTHER = "K", "ĸ"


def ascii_words(text: Column) -> Column:
    """Words as an array, in lower case. ASCII letters only come from ASCII letters, which is all that is compared."""
    return F.split(F.lower(F.replace(text, F.lit(_KELVIN), F.lit(_OTHER))), GAP)


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[0-9A-Za-z]+", text)))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("bigint")


def phrase_columns(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase: how many, words before the first, words behind the last (null without any)."""
    pattern = f"(?i){phrase[0]}(?<!{WORD}{phrase[0]})" + GAP.join(phrase.split(" "))[1:] + f"(?!{WORD})"
    parts = F.split(text, pattern, -1)
    found = text.rlike(pattern)
    count = F.when(found, F.size(parts) - 1).otherwise(0)
    before = F.when(found, n_words(F.get(parts, F.lit(0))))
    behind = F.when(found, n_words(F.element_at(parts, -1)))
    return count, before, behind


def word_frequencies(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """Number of documents with each template word (a fixed vocabulary, so at most that many rows come back)."""
    present = F.array_intersect(ascii_words(col(text)), F.array(*[F.lit(w) for w in words]))
    counted = docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def ordered_templates(docs: DataFrame, templates, threshold: float, text: str = "text") -> tuple[list[dict], dict[str, int]]:
    """Templates with ranked words, the needed overlap and the prefix length; and the rank of every word."""
    sets = [(label, template_words(notice)) for label, notice in templates]
    words = sorted({w for _, ws in sets for w in ws})
    often = word_frequencies(docs, words, text)
    rank = {w: i for i, w in enumerate(sorted(words, key=lambda w: (often.get(w, 0), w)))}
    out = []
    for number, (label, ws) in enumerate(sets):
        ranks = sorted(rank[w] for w in ws)
        needed = math.ceil(threshold * len(ranks) - 1e-9)
        out.append({"template": number, "label": label, "ranks": ranks, "needed": needed, "prefix": len(ranks) - needed + 1})
    return out, rank


def windows(words: Column, step: int) -> Column:
    """Blocks of (STRETCH + 1) * step words, one every ``step`` words; any STRETCH * step words in a row lie in one."""
    last = F.greatest(F.lit(0), F.ceil(F.size(words) / step) - STRETCH - 1).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("block"), F.slice(words, k * step + 1, (STRETCH + 1) * step).alias("words"))
    )


def similar_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every (block, template) pair with a stretch of the block that holds at least ``threshold`` of the template.

    Columns: the keys, block (number from 0, see :func:`windows`), words, label, containment (of its best stretch). A notice may be found
    in several overlapping blocks. Null and empty texts have a block without words, which matches nothing.
    """
    spark = docs.sparkSession
    found, rank = ordered_templates(docs, templates, threshold, text)
    index = [
        (w, t["template"], t["label"], i, len(t["ranks"]), t["needed"], t["ranks"])
        for t in found
        for i, w in enumerate(t["ranks"][: t["prefix"]])
    ]
    # one row per prefix word of a literal template
    index = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, at int, size int, needed int, ranks array<int>"))
    by_rank = sorted(rank, key=rank.get)
    first_words = sorted({r for t in found for r in t["ranks"][: t["prefix"]]})
    rare = F.array(*[F.lit(by_rank[r]) for r in first_words])
    rows = docs.select(*[col(k) for k in keys], ascii_words(col(text)).alias("_all")).filter(F.arrays_overlap("_all", rare))
    cut = F.filter(windows(F.col("_all"), max(len(t["ranks"]) for t in found)), lambda b: F.arrays_overlap(b["words"], rare))
    blocks = rows.select(*[col(k) for k in keys], F.inline(cut))
    rank_of = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    # places of template words, and their distinct ranks
    places = F.transform("words", lambda w, i: F.struct(i.alias("place"), F.element_at(rank_of, w).alias("rank")))
    blocks = blocks.withColumn("_places", F.filter(places, lambda p: p["rank"].isNotNull()))
    blocks = blocks.withColumn("_ranks", F.array_sort(F.array_distinct("_places.rank")))
    tokens = blocks.select("*", F.posexplode("_ranks").alias("_at", "rank"))
    pairs = tokens.join(index, "rank").filter(F.size("_ranks") >= F.col("needed"))
    # of the prefix words at which a pair meets, the first common one speaks for it
    before = F.array_intersect(F.slice("_ranks", 1, F.col("_at")), F.slice("ranks", 1, F.col("at")))
    pairs = pairs.filter(F.size(before) == 0)
    pairs = pairs.filter(F.least(F.col("size") - F.col("at"), F.size("_ranks") - F.col("_at")) >= F.col("needed"))
    pairs = pairs.filter(F.size(F.array_intersect("_ranks", "ranks")) >= F.col("needed"))
    # a best stretch can begin with a word of the template
    own = F.filter("_places", lambda p: F.array_contains(F.col("ranks"), p["rank"]))
    pairs = pairs.withColumn("_places", own)

    def held(first: Column) -> Column:
        inside = F.filter("_places", lambda p: p["place"].between(first["place"], first["place"] + STRETCH * F.col("size") - 1))
        return F.size(F.array_distinct(F.transform(inside, lambda p: p["rank"])))

    pairs = pairs.withColumn("_common", F.array_max(F.transform("_places", held))).filter(F.col("_common") >= F.col("needed"))
    containment = (F.col("_common") / F.col("size")).alias("containment")
    return pairs.select(*[col(k) for k in keys], "block", "words", "label", containment)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns: places where a phrase's words stand next to each other, words counted from 0. ``labels`` adds the
    templates' labels; ``score`` is 1 with a base phrase, else the best containment found, else 0. Null texts count
    as empty: no words, no labels, score 0. Rows that repeat key and text get the same answer each; null keys are keys like any other. Very
    long texts are scanned whole, and words that are far apart in them make no notice. An empty table gives no rows. Extra columns are
    not read.
    """
    value = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(key).alias("key"), F.xxhash64(value).alias("version"), value.alias("text"))
    found = similar_blocks(rows, templates, threshold, "text", ("key", "version"))
    labels = found.groupBy("key", "version").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = rows.withColumn("n_words", n_words(F.col("text")))
    columns = {}
    for i, phrase in enumerate(PHRASES):
        count, before, behind = phrase_columns(F.col("text"), phrase)
        size = len(phrase.split(" "))
        columns |= {f"c{i}": count, f"f{i}": before, f"l{i}": F.col("n_words") - behind - size}
    base = base.withColumns(columns).drop("text")
    every = range(len(PHRASES))
    label = F.array(*[F.when(F.col(f"c{i}") > 0, F.lit(name)) for i, name in enumerate(PHRASES.values())])
    base = base.select(
        "key",
        "version",
        "n_words",
        sum((F.col(f"c{i}") for i in every), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(F.array(*[F.col(f"f{i}") for i in every])).alias("first_word"),
        F.array_max(F.array(*[F.col(f"l{i}") for i in every])).alias("last_word"),
        F.array_sort(F.array_compact(label)).alias("base"),
    )
    same = base["key"].eqNullSafe(labels["key"]) & (base["version"] == labels["version"])
    joined = base.join(labels, same, "left").select(base["key"], "n_words", "n_base", "first_word", "last_word", "base", "more", "best")
    every_label = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("CAST(array() AS array<string>)"))))
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every_label, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
