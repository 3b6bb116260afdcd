"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a document are hashed and joined to their places in license templates. A k-gram at
document place i and template place j votes for the diagonal i - j. Neighbouring diagonals are merged, since an
inserted or missing word shifts a copy by one, and a span is verified by the share of its template's words that
its votes cover, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label and wording of common license notices. The public texts of the notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "All rights reserved"),
)
#: Phrases whose places are always counted, and their labels (fixed values).
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
K = 3
#: Diagonals this far apart are one span.
DRIFT = 2
#: Share of a template's words that a span must cover.
COVER = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none.

    ``lower`` is faster than ``translate`` and does the same to A-Z. Of other letters it makes other letters, which
    no template has, but for two that become ASCII and are put aside first.
    """
    aside = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(aside), _GAPS), "")


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()


def template_places(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K) -> DataFrame:
    """(h, template, label, size, j): hash and place of each k-gram of the templates; as many rows as they have words."""
    rows = [
        (t, label, len(found), j, found[j : j + k])
        for t, (label, text) in enumerate(templates)
        for found in [_template_words(text)]
        for j in range(len(found) - k + 1)
    ]
    df = spark.createDataFrame(rows, "template int, label string, size int, j int, gram array<string>")
    return df.withColumn("h", F.xxhash64(*[F.col("gram")[x] for x in range(k)]))


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """(doc_id, text_hash, label, template, first_word, last_word, share) of the verified spans of ``docs`` (doc_id, words, text_hash).

    ``first_word`` and ``last_word`` are the first and last words that votes cover; ``share`` is the covered share
    of the template. Equal rows of ``docs`` count once.
    """
    rows = docs.select("doc_id", "text_hash", "words", F.explode(F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))).alias("i"))
    rows = rows.withColumn("h", F.xxhash64(*[F.col("words")[F.col("i") + x] for x in range(k)]))
    places = F.broadcast(template_places(docs.sparkSession, templates, k))  # the templates' words, a fixed number
    votes = rows.join(places, "h").where(F.slice("words", F.col("i") + 1, F.lit(k)) == F.col("gram"))
    diagonal = (F.col("i") - F.col("j")).alias("diagonal")
    voted = votes.groupBy("doc_id", "text_hash", "template", "label", "size", diagonal).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    line = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= drift, 0).otherwise(1)
    merged = voted.withColumn("new", new).withColumn("island", F.sum("new").over(line))
    merged = merged.groupBy("doc_id", "text_hash", "template", "label", "size", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("first").alias("first_word"), (F.max("last") + k - 1).alias("last_word")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + k - 1)))))
    return merged.withColumn("share", covered / F.col("size")).where(F.col("share") >= cover).drop("js", "size", "island")


def _phrase_places(found: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of a phrase in an array of words."""
    last = F.size(found) - len(phrase)
    same = lambda i: [found[i + k] == w for k, w in enumerate(phrase)]

    def starts_here(i: Column) -> Column:
        out = same(i)[0]
        for more in same(i)[1:]:
            out = out & more
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), starts_here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs`` (doc_id, text).

    ``n_base`` counts the places of PHRASES, ``first_word`` and ``last_word`` are their smallest and largest start,
    null without any. ``labels`` adds the labels of verified spans. ``score`` is the largest covered share of a
    template, 1 where a phrase stands, 0 without license. Null and empty texts have no words; null ids and repeated
    rows come out as they are. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    found = spans(own).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    # most documents hold no phrase, which one search in the joined words tells
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    step = own.withColumn("joined", joined)
    none = F.array().cast("array<int>")
    step = step.withColumns({
        f"p{n}": F.when(F.contains("joined", F.lit(f" {' '.join(phrase)} ")), _phrase_places(F.col("words"), phrase)).otherwise(none)
        for n, phrase in enumerate(PHRASES)
    })
    every = F.concat(*[F.col(f"p{n}") for n in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, label in enumerate(PHRASES.values())]))
    once = F.inline(F.array(F.struct(
        F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(labels).alias("base"),
    )))
    base = step.select("doc_id", "text_hash", once)
    both = base.join(found, base.doc_id.eqNullSafe(found.id) & (base.text_hash == found.hash), "left")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"),
    )
