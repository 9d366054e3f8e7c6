"""Licence scan by a positional index of rare words, in DataFrame functions only.

``TEMPLATES`` holds short licence notices.  A first pass counts, over all texts, how many documents hold each word of the templates.  The
index then has, for every template, its words of highest IDF with their positions (postings), and for every phrase its word of
highest IDF.  A second pass looks the words of each file up: a phrase is found where its rarest word stands with the
phrase's other words around it; each posting of a rare word votes for the place where its template would begin.
Votes for one template that agree in that place, up to ``SLACK`` words, are intersected: a template is found where
rare words with ``NEED`` of its weight agree and all its mandatory phrases stand at their places.

Both passes read a text once and keep numbers only; what leaves a row are the few places of rare words, one row each, so
that a text full of them spreads over tasks.  The words of the templates bound what the driver holds and what is sent along.

Defined cases: null text is empty and has no words; empty label lists are empty texts; places and scores of texts
without findings are null and 0; repeated rows and rows without doc_id each get their row; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from math import ceil, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.landing import land

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 8
NEED = 0.7
SLACK = 8

# Phrases that are a finding by themselves, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    must: tuple[str, ...]


# Notices by which licences are known, in lower case and without punctuation, and what a file must hold of each.
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "licensed under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
             "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
             "distribute sublicense and or sell copies of the software", ("hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
             "http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
             "published by the free software foundation", ("free software you can redistribute it", "published by the free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd", "licensed under the bsd license", ("the bsd license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
             "the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
)


class Index(NamedTuple):
    """Postings of rare words (word, template, position, number, share of the template's weight), the phrases (their words, the place of the
    rarest one, and that word), and where templates want them (phrase, template, position, number)."""
    postings: list[tuple[str, int, int, int, float]]
    phrases: list[tuple[list[str], int, str]]
    wanted: list[tuple[int, int, int, int]]


def find(words: list[str], phrase: list[str]) -> int:
    """Where the phrase first stands in the words."""
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def licence_words(templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE) -> list[str]:
    return sorted({w for text in (*base, *(t.text for t in templates)) for w in text.split()})


def build_index(weights: dict[str, float], templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, rare: int = RARE) -> Index:
    """The base phrases come first among the phrases.  Of words of equal weight the first in order is the rarer one."""
    postings, wanted = [], []
    texts = list(base) + sorted({m for t in templates for m in t.must} - set(base))
    phrases = []
    for text in texts:
        words = text.split()
        at = min(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))
        phrases.append((words, at, words[at]))
    for t, template in enumerate(templates):
        words = template.text.split()
        distinct = sorted(set(words), key=lambda w: (-weights[w], w))
        chosen = distinct[:min(rare, ceil(len(distinct) / 2))]
        total = sum(weights[w] for w in chosen)
        postings += [(w, t, i, k, weights[w] / total) for k, w in enumerate(chosen) for i, x in enumerate(words) if x == w]
        wanted += [(texts.index(m), t, find(words, m.split()), k) for k, m in enumerate(template.must)]
    return Index(postings, phrases, wanted)


def file_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_weights(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """IDF of the given words over all texts."""
    held = docs.select(F.array_distinct(F.filter(file_words(F.col("text")), lambda w: w.isin(words))).alias("held"))
    known = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in known}
    return {w: log(1 + (1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in words}


def looked_up(docs: DataFrame, index: Index) -> DataFrame:
    """(row, doc_id, n_words, hits, places): where rare words stand, and where phrases begin, by their number."""
    rare = sorted({p[0] for p in index.postings})
    kept = sorted({*rare, *(word for _, _, word in index.phrases)})
    found = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(kept), F.struct(w.alias("word"), i.alias("at")))))

    def begins(number: int, words: list[str], before: int, word: str) -> Column:
        there = F.filter("found", lambda x: (x["word"] == word) & (x["at"] >= before) & (
            F.slice("words", F.greatest(x["at"] - before + 1, F.lit(1)), len(words)) == F.array(*map(F.lit, words))))
        return F.transform(there, lambda x: F.struct(F.lit(number).alias("phrase"), (x["at"] - before).alias("start")))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), file_words(F.col("text")).alias("words"))
    places = F.concat(*(begins(k, *p) for k, p in enumerate(index.phrases)))
    none = F.expr("CAST(array() AS array<struct<phrase:int,start:int>>)")
    return rows.withColumn("found", found).select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.filter("found", lambda x: x["word"].isin(rare)).alias("hits"),
        F.when(F.size("found") > 0, places).otherwise(none).alias("places"))


def template_finds(looked: DataFrame, index: Index, templates: tuple[Template, ...] = TEMPLATES, need: float = NEED, slack: int = SLACK) -> DataFrame:
    """(row, labels, share) of rows in which a template is found: its votes that agree in the place where it begins, and its phrases there."""
    spark = looked.sparkSession
    postings = F.broadcast(spark.createDataFrame(index.postings, "word string, t int, pos int, k int, share double"))
    wanted = F.broadcast(spark.createDataFrame(index.wanted, "phrase int, t int, pos int, k int"))
    rare = looked.select("row", F.inline("hits")).join(postings, "word") \
        .select("row", "t", (F.col("at") - F.col("pos")).alias("start"), "k", "share")
    phrases = looked.select("row", F.inline("places")).join(wanted, "phrase") \
        .select("row", "t", (F.col("start") - F.col("pos")).alias("start"), (-1 - F.col("k")).alias("k"), F.lit(0.0).alias("share"))
    # two rows of slots, half a slot apart: places up to ``slack`` words apart share a slot in one of them
    slots = F.array(*(F.struct(F.lit(s).alias("side"), F.floor((F.col("start") + s * slack) / (2 * slack)).alias("slot")) for s in (0, 1)))
    votes = rare.union(phrases).select("row", "t", "k", "share", F.inline(slots))
    numbers = range(1 + max([p[3] for p in index.postings], default=0))
    musts = range(1 + max([p[3] for p in index.wanted], default=0))
    agreed = votes.groupBy("row", "t", "side", "slot").agg(
        *(F.max(F.when(F.col("k") == k, F.col("share"))).alias(f"s{k}") for k in numbers), *(F.max(F.col("k") == -1 - k).alias(f"m{k}") for k in musts))
    share = sum((F.coalesce(f"s{k}", F.lit(0.0)) for k in numbers), F.lit(0.0))
    held = sum((F.col(f"m{k}").cast("int") for k in musts), F.lit(0))
    names = F.broadcast(spark.createDataFrame([(t, x.label, len(x.must)) for t, x in enumerate(templates)], "t int, label string, musts int"))
    return agreed.select("row", "t", share.alias("share"), held.alias("held")).where(F.col("share") >= need).join(names, "t").where("held = musts") \
        .groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.  The score is 1 where a base phrase stands, else
    the greatest share of a found template's weight."""
    index = build_index(word_weights(docs, licence_words(templates, base)), templates, base)
    looked = land(looked_up(docs, index))
    names = F.array(*map(F.lit, base.values()))
    starts = F.filter("places", lambda x: x["phrase"] < len(base))
    rows = looked.select("row", "doc_id", "n_words", F.transform(starts, lambda x: x["start"].cast("long")).alias("starts"),
                         F.array_distinct(F.transform(starts, lambda x: F.element_at(names, x["phrase"] + 1))).alias("base"))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    found = rows.join(template_finds(looked, index, templates), "row", "left")
    every = F.array_union("base", F.coalesce("labels", F.expr("CAST(array() AS array<string>)")))
    score = F.when(F.size("starts") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)))
    return found.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"),
                        F.array_max("starts").alias("last_word"), listed(F.col("base")).alias("base_labels"), listed(every).alias("labels"), score.alias("score"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES: dict[str, str] = {}
