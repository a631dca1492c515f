"""License scans by diagonal voting: word bigrams joined to template places, counted per offset diagonal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import let

#: Fixed: A-Z is lower-cased, then words are runs of digits, a-z and anything beyond ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAM = 2


@dataclass(frozen=True)
class Template:
    """``phrase``: every word counts and must stand. Else a notice, found by the share of its anchor bigrams."""

    label: str
    text: str
    phrase: bool = False

    def words(self) -> list[str]:
        import re

        return [w for w in re.split(r"[^0-9a-z]+", self.text.lower()) if w]

    def grams(self) -> list[tuple[int, str, str]]:
        """(place, word, next word); bigrams of two function words anchor nothing and have no vote."""
        w = self.words()
        all_ = [(i, w[i], w[i + 1]) for i in range(len(w) - 1)]
        return all_ if self.phrase else [g for g in all_ if not {g[1], g[2]} <= FUNCTION_WORDS]


FUNCTION_WORDS = set("a an and any are as at be by for from in is it its no not of on or such that the this to under with without you".split())

#: Phrases and their labels are fixed by the data contract; the notices are the customary short forms.
TEMPLATES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by", "licensed under a Creative Commons Attribution International License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(h, tid, tpos, votes, phrase, label): one row per template bigram, and one that every text's end marker meets."""
    rows = [
        (w1, w2, tid, i, len(t.grams()), t.phrase, t.label)
        for tid, t in enumerate(templates) for i, w1, w2 in t.grams()
    ]
    schema = "w1 string, w2 string, tid int, tpos int, votes int, phrase boolean, label string"
    table = spark.createDataFrame([*rows, (None, None, -1, 0, 1, False, None)], schema)
    return table.select(F.xxhash64("w1", "w2").alias("h"), "tid", "tpos", "votes", "phrase", "label")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES,
    coverage: float = 0.75, band: int = 3,
) -> DataFrame:
    """Verified spans, and one row with label null per text: row, ``id_col``, n_words, label, phrase, first_word, last_word, score.

    All rolling bigrams of all texts are joined to the templates' bigrams (a broadcast of a few
    hundred rows: its size is that of ``templates``, not of the data). A hit votes for the diagonal word place minus template place. Full
    votes on one diagonal are a phrase word for word. For notices, diagonals at most ``band`` apart
    (words put in or left out) are merged, and the merged span holds if its distinct template places are
    at least ``coverage`` of the anchors and its words are not stretched beyond the template's by more
    than half. The one exchange deals the hits out by row, so no key is larger than a text.

    Null or empty texts have no words and only the row with label null. ``row`` tells repeated
    rows apart, so they do not add up. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(text, GAPS), "")
    end = F.xxhash64(F.lit(None).cast("string"), F.lit(None).cast("string"))
    gram = lambda w: lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))
    hashes = lambda w: F.when(F.size(w) < GRAM, F.array(end)).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), gram(w)), F.array(end))
    )
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), hashes(w).alias("h"))).alias("w"))
    exploded = base.select("row", "id", F.col("w.n").alias("n_words"), F.posexplode("w.h").alias("pos", "h"))
    hits = exploded.join(F.broadcast(template_table(spark, templates)), "h").repartition("row")

    votes = hits.withColumn("diag", F.col("pos") - F.col("tpos")).groupBy(
        "row", "id", "n_words", "tid", "votes", "phrase", "label", "diag"
    ).agg(F.count(F.lit(1)).alias("got"), F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = Window.partitionBy("row", "tid").orderBy("diag")
    apart = F.coalesce(F.col("diag") - F.lag("diag").over(by) > band, F.lit(True)) | F.col("phrase") | (F.col("tid") < 0)
    merged = votes.withColumn("part", F.sum(apart.cast("int")).over(by)).groupBy(
        "row", "id", "n_words", "tid", "votes", "phrase", "label", "part"
    ).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("got"),
        F.min("first").alias("first_word"), (F.max("last") + GRAM - 1).alias("last_word"),
        (F.max("diag") - F.min("diag")).alias("spread"),
    )
    share = F.col("got") / F.col("votes")
    holds = F.when(F.col("phrase"), F.col("got") == F.col("votes")).otherwise(
        (share >= coverage) & (F.col("last_word") - F.col("first_word") <= 1.5 * F.col("votes") + 12)
    )
    return merged.filter(F.col("label").isNull() | holds).select(
        "row", F.col("id").alias(id_col), "n_words", "label", "phrase",
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.when(F.col("label").isNotNull(), share).otherwise(0.0).alias("score"),
    )


def summarize(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text of ``scan``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    phrase = F.col("phrase") & F.col("label").isNotNull()
    return spans.groupBy("row", id_col, "n_words").agg(
        F.count_if(phrase).alias("n_base"), F.min(F.when(phrase, F.col("first_word"))).alias("first_word"),
        F.max(F.when(phrase, F.col("first_word"))).alias("last_word"),
        names(F.when(phrase, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    ).drop("row")
