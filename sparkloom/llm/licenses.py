"""License notices in texts, found by votes of word k-grams for the diagonals of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import named, text_or_empty, written

#: A word. Fixed value.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels that always count. Fixed values.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Notices that licenses ask for, or open with, and the labels that they add. Wording of the public licenses.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def needed(words: int) -> int:
    """How many words of a notice have to stand in a text: all of a short one, one after another, and four fifths of one with ten and more."""
    return words if words < 10 else -(-4 * words // 5)


def _templates(spark: SparkSession, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """One row for each k-gram of a template: ``gram, k, template, at, grams, words, label, base``. Phrases have 2-grams."""
    rows = []
    for nth, (label, text) in enumerate((*phrases, *notices)):
        words, base = text.split(), nth < len(phrases)
        size = 2 if base else min(k, len(words))
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        rows += [(" ".join(words[i : i + size]), size, nth, i, len(words) - size + 1, len(words), needed(len(words)), label, base) for i in range(len(words) - size + 1)]
    return spark.createDataFrame(rows, "template_gram string, k int, template int, at int, grams int, words int, needed int, label string, base boolean")


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case. ``lower`` is the faster one and the same for ASCII; elsewhere it changes more than A-Z."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _grams(words: str, k: int) -> Column:
    """All runs of ``k`` words as ``size, pos, gram`` (joined by a space); none of a text with fewer."""
    starts = F.sequence(F.lit(0), F.size(words) - k)
    gram = lambda i: F.concat_ws(" ", *[F.element_at(words, i + j + 1) for j in range(k)])
    runs = F.transform(starts, lambda i: F.struct(F.lit(k).alias("size"), i.alias("pos"), gram(i).alias("gram")))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<struct<size:int,pos:int,gram:string>>"))


def license_spans(rows: DataFrame, k: int = 3, slack: int = 3, phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """Places of templates in ``rows`` (``rid, text``; ``rid`` tells rows apart): ``rid, template, label, base, first_word, last_word, share``. And
    ``rid, n_words`` of each row, from the same scan: a text is cut into words once.

    Every run of two and of ``k`` words is joined by its hash to the places of templates that have it, and equal hashes are held against the words
    themselves. A hit votes for its diagonal (its place in the text less that in the template), on which an unchanged copy has all its votes. A phrase
    counts where its diagonal has every vote. Diagonals of a notice at most ``slack`` words apart are one span (words were put in or left out there);
    ``share`` is how much of the notice its verified runs cover, each word of it once.
    """
    spark = rows.sparkSession
    templates = _templates(spark, phrases, notices, k)
    sizes = sorted({2} | {r.k for r in templates.select("k").distinct().collect()})  # of a fixed list
    # a run of no words stands for the text itself, whose number of words is its place
    whole_text = spark.createDataFrame([("", 0, -1, 0, 0, 0, 0, None, False)], templates.schema)
    templates = templates.unionByName(whole_text).withColumn("hash", F.xxhash64("template_gram"))
    tokens = rows.select("rid", words_of(F.col("text")).alias("w"))
    itself = F.array(F.struct(F.lit(0).alias("size"), F.size("w").alias("pos"), F.lit("").alias("gram")))
    every = tokens.select("rid", F.inline(F.concat(itself, *[_grams("w", size) for size in sizes])))
    hits = (
        every.withColumn("hash", F.xxhash64("gram"))
        .join(F.broadcast(templates), "hash")  # some hundred rows: the fixed list
        .where((F.col("gram") == F.col("template_gram")) & (F.col("size") == F.col("k")))
    )
    same = ["template", "label", "base", "grams", "words", "needed", "k"]
    votes = hits.groupBy("rid", *same, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_set("at")).alias("at"))
    votes = written(votes, "license-votes")  # few; texts are scanned once for both kinds of template, and for the number of words
    counted = votes.where("template = -1").select("rid", F.col("diagonal").cast("long").alias("n_words"))
    votes = votes.where("template >= 0")
    whole = votes.where("base AND votes = grams").select("rid", "template", "label", "base", F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("words") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("share"))
    along = W.partitionBy("rid", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True)).cast("int")
    spans = votes.where("NOT base").withColumn("far", far).withColumn("span", F.sum("far").over(along))
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("k") - 1)))
    merged = spans.select("*", covered.alias("covered")).groupBy("rid", *same, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("found"),
        F.min(F.col("diagonal") + F.array_min("at")).cast("long").alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("at") + F.col("k") - 1).cast("long").alias("last_word"),
    )
    unbroken = (F.col("words") >= 10) | (F.col("last_word") - F.col("first_word") + 1 == F.col("words"))
    long = merged.select("rid", "template", F.when((F.col("found") >= F.col("needed")) & unbroken, F.col("label")).alias("label"), "base", "first_word", "last_word", (F.col("found") / F.col("words")).alias("share"))
    return whole.unionByName(long), counted


def licenses(docs: DataFrame, k: int = 3, slack: int = 3) -> DataFrame:
    """License notices of every text of ``docs`` (``doc_id, text``), in words with A-Z in lower case.

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and ``last_word`` are the smallest and largest of their starts (null without any),
    ``base_labels`` their labels. ``labels`` has those too and the labels of notices of which enough words stand in the text (``license_spans``);
    ``score`` is the largest share of a phrase or notice that was verified, 0 without any. Labels are distinct, sorted and joined by commas.

    Null text counts as empty; a null doc_id is returned as it is. Rows are scanned each, repeated ones too. Texts are scanned whole, whatever their
    length: a row of a join is one run of words. An empty table gives an empty result; further columns are not read.
    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    """
    rows = named(docs, "licenses", "doc_id", text_or_empty().alias("text"))
    spans, counted = license_spans(rows.select("rid", "text"), k, slack)
    start = F.when(F.col("base"), F.col("first_word"))
    found = spans.groupBy("rid").agg(
        F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    return rows.select("rid", "doc_id").join(counted, "rid").join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
