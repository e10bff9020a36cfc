"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the places where license
templates hold the same k-gram. Hits on one diagonal (place in the text less place in the
template) vote for one alignment; neighbouring diagonals, a few inserted or dropped words
apart, are merged, and a merged span counts when its votes cover enough of the template
and it is not stretched too far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failcast.llm.words import ALNUM_BYTES, BLOCK_BYTES, find_words, text_bytes, windows
from failcast.scratch import materialize

GRAM = 2
#: Stands behind each text's last k-gram, so that every text has a row.
END = 0
#: More template places than this are joined by a shuffle instead of a broadcast.
BROADCAST_PLACES = 200_000
#: Diagonals this many words apart are neighbours; a diagonal needs so many votes to be merged;
#: a span must cover this share of its template and be at most so many times its length.
GAP, LEAST_VOTES, COVER, STRETCH = 4, 3, 0.7, 1.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # base phrases count where all their words stand consecutively


#: The stated phrases and labels.
BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))
#: The method's own templates: opening words of common licenses.
COMMON = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("creative-commons", "this work is licensed under a creative commons attribution license"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
    Template("as-is", "the software is provided as is without warranty of any kind express or implied"),
)


def _grams(data: np.ndarray, offsets: np.ndarray, k: int):
    w = find_words(data, offsets, ALNUM_BYTES, lower=True)
    grams, at = windows(w.hashes(), w.first, k)
    grams[grams == END] = 1  # END is no k-gram's hash
    return w.counts, grams.view(np.int64), np.searchsorted(at, w.first)


def word_grams(text: Column, k: int = GRAM) -> Column:
    """Struct of n_words and grams: the hash of the k words from each word on (words of A-Z lowered text)."""
    @F.arrow_udf("n_words long, grams array<long>")
    def roll(column: pa.Array) -> pa.Array:
        data, offsets = text_bytes(column)
        counts, grams, edges, at, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0, 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            n, g, edge = _grams(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at], k)
            counts.append(n), grams.append(g), edges.append(edge[1:] + done)
            at, done = to, done + len(g)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(edges), pa.int32()), pa.array(np.concatenate(grams)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), lists], ["n_words", "grams"])

    return roll(text)


def template_places(spark, templates, k: int = GRAM) -> DataFrame:
    """Per k-gram of each template: gram, template, place."""
    rows = []
    for i, t in enumerate(templates):
        n, grams, _ = _grams(*text_bytes(pa.array([t.text])), k)
        if n[0] < k:
            raise ValueError(f"{t.text!r} has fewer than {k} words")
        rows += [(int(g), i, p) for p, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def hits(docs: DataFrame, templates, k: int = GRAM) -> DataFrame:
    """One row per agreement of a text's k-gram with a template's, and one with template -1 per row of ``docs``.

    Texts are known by doc_id and a hash of the text, so rows with one id stay apart.
    """
    places = template_places(docs.sparkSession, templates, k).unionByName(
        docs.sparkSession.createDataFrame([(END, -1, 0)], "gram long, template int, place int"))
    if places.count() <= BROADCAST_PLACES:
        places = F.broadcast(places)
    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_grams(F.col("text"), k).alias("w"))
    rolled = made.select("doc_id", "text_hash", F.col("w.n_words").alias("n_words"),
                         F.posexplode(F.array_append("w.grams", F.lit(END).cast("long"))).alias("at", "here"))
    return rolled.join(places, F.col("here") == F.col("gram")).select("doc_id", "text_hash", "n_words", "template", "place", "at")


def spans(found: DataFrame, templates, k: int = GRAM) -> DataFrame:
    """Verified spans: doc_id, text_hash, n_words, label, is_base, start, stop, cover."""
    spark = found.sparkSession
    facts = spark.createDataFrame([(i, t.label, t.base, len(t.text.split())) for i, t in enumerate(templates)],
                                  "template int, label string, is_base boolean, words int")
    text = ["doc_id", "text_hash", "n_words"]
    lines = (found.where("template >= 0").groupBy(*text, "template", (F.col("at") - F.col("place")).alias("diagonal"))
             .agg(F.collect_set("place").alias("places")).join(F.broadcast(facts), "template"))
    grams = F.col("words") - (k - 1)
    votes = F.size("places")
    whole = F.col("is_base") & (votes == grams)
    strong = ~F.col("is_base") & (votes >= F.least(F.lit(LEAST_VOTES), grams))
    along = Window.partitionBy(*text, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    merged = (lines.where(whole | strong)
              .withColumn("__new", F.when(F.col("is_base") | (F.coalesce(apart, F.lit(GAP + 1)) > GAP), 1).otherwise(0))
              .withColumn("__group", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*text, "template", "label", "is_base", "words", "__group")
              .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
                   F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
                   F.max(F.col("diagonal") + F.array_max("places") + k).alias("stop")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    return (merged.withColumn("cover", covered / F.col("words"))
            .where((F.col("cover") >= COVER) & (F.col("stop") - F.col("start") <= STRETCH * F.col("words")))
            .select(*text, "label", "is_base", F.col("start").cast("long"), F.col("stop").cast("long"), "cover"))


def license_spans(docs: DataFrame, templates=BASE + COMMON) -> DataFrame:
    """Where templates stand in each text: doc_id, text_hash, n_words, label, is_base, start, stop, cover (words from 0)."""
    return spans(materialize(hits(docs, templates), "license_hits"), templates)


def scan(docs: DataFrame, templates=BASE + COMMON) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that a span covers, 0 without any. A null or empty text
    has no words and no labels; rows that are equal get equal results, each its own row.
    """
    found = materialize(hits(docs, templates), "license_hits")
    text = ["doc_id", "text_hash", "n_words"]
    rows = found.where("template < 0").groupBy(*text).agg(F.count("*").alias("copies"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("is_base")
    per_text = spans(found, templates).groupBy(*text).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("cover").alias("score"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    out = rows.alias("a").join(per_text.alias("b"), same, "left").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("a.doc_id", "a.n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
