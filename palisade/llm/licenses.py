"""License scan by diagonal voting.

Every text is cut into words, and every run of GRAM words that a license template has is joined to the places where it
stands in the templates; other runs are dropped before they are rows. A match of a text place with a template place votes for their difference, the diagonal. Votes are added
up by document, template and diagonal; neighbouring diagonals whose votes lie close together are merged into one
span, since a word put in or left out shifts the rest by one; a span is verified by the share of the template's
words that its matched runs cover. Runs are compared by their words, so votes are exact.

The template table is fixed in the code (its size is checked before it is broadcast; beyond the bound it is joined
by shuffle). Documents without a match are never shuffled.

Defined results: a null or empty text has no words; texts shorter than GRAM words have no votes; a doc_id that
stands on several rows with different texts is as many documents (rows are told apart by their texts' hashes, with and
without a doc_id), and equal rows are one document whose results each gets; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import stored

GRAM = 3
#: Diagonals merge if they differ by no more, and their votes lie within so many words of each other.
NEAR_DIAGONALS, NEAR_WORDS = 4, 40
MIN_COVERAGE = 0.6
MAX_BROADCAST_ROWS = 100_000

# Phrases whose every place counts, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public notices.
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
    ],
    "gpl-3": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this work is licensed under the gnu general public license version 3",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc 4 0"],
    "all-rights": ["all rights reserved"],
}

WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def folded(text: Column) -> Column:
    """Text whose A-Z are lower-case. lower() turns one letter that isn't ASCII into an ASCII one, the Kelvin sign; it
    is replaced first by a letter that stays outside ASCII. Other letters may change, but words and ASCII don't."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("å")))


def templates() -> list[tuple[int, str, str, int, bool]]:
    """(template, label, words, number of words, counts as base)."""
    rows = [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, text, False) for label, texts in NOTICES.items() for text in texts]
    return [(i, label, text, len(text.split()), base) for i, (label, text, base) in enumerate(rows)]


def template_runs() -> list[tuple[str, int, str, int, bool, int]]:
    """(gram, template, label, size, is_base, at)."""
    return [(" ".join(text.split()[at : at + GRAM]), i, label, size, base, at) for i, label, text, size, base in templates() for at in range(size - GRAM + 1)]


def template_grams(docs: DataFrame) -> DataFrame:
    """(gram, template, label, size, is_base, at)."""
    rows = template_runs()
    grams = docs.sparkSession.createDataFrame(rows, "gram string, template int, label string, size int, is_base boolean, at int")
    return F.broadcast(grams) if len(rows) <= MAX_BROADCAST_ROWS else grams


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def words() -> Column:
    return F.array_remove(F.split(folded(F.col("text")), WORD_GAP), "")


def known_runs(words: Column) -> Column:
    """(place, gram) of the runs that stand in a template. A run is put together only if each of its words has that place in one."""
    known = sorted({gram for gram, *_ in template_runs()})
    nth = [sorted({gram.split()[j] for gram in known}) for j in range(GRAM)]
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(GRAM)])
    fits = lambda i: reduce(and_, [F.get(words, i + j).isin(nth[j]) for j in range(GRAM)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: fits(i) & run(i).isin(known))
    return F.when(F.size(words) >= GRAM, F.transform(places, lambda i: F.struct(i.alias("place"), run(i).alias("gram"))))


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, runs) of each row. It is stored, since votes and rows of the report both need it and the texts shall be cut once."""
    cut = docs.select("doc_id", text_key(), words().alias("words"))
    return stored(cut.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), known_runs(F.col("words")).alias("runs")), "license-texts")


def votes(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, label, size, is_base, at, place): each match of a run of words with a template's place, once."""
    rows = texts.select("doc_id", "text_key", F.inline("runs"))
    return rows.join(template_grams(texts), "gram").drop("gram").distinct()


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, label, is_base, first, last, covered, score, wholes) of merged diagonals."""
    # Words that a diagonal's runs cover: each run adds GRAM words, less what overlaps the run before.
    same = Window.partitionBy("doc_id", "text_key", "template", "diagonal").orderBy("at")
    lines = (
        found.withColumn("diagonal", F.col("place") - F.col("at"))
        .withColumn("new", F.least(F.lit(GRAM), F.coalesce(F.col("at") - F.lag("at").over(same), F.lit(GRAM))))
        .groupBy("doc_id", "text_key", "template", "label", "size", "is_base", "diagonal")
        .agg(F.count("*").alias("n"), F.sum("new").alias("covered"), F.min("place").alias("first"), F.max("place").alias("last"))
    )
    # A diagonal opens a span unless the one before it in the document is near, by words and by its number.
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("first", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= NEAR_DIAGONALS) & (F.col("first") - F.lag("last").over(order) <= NEAR_WORDS)
    opened = lines.withColumn("opens", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("opens").over(order))
    merged = opened.groupBy("doc_id", "text_key", "template", "label", "size", "is_base", "span").agg(
        F.least(F.sum("covered"), F.first("size")).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last_run"), F.sum(F.when(F.col("n") == F.col("size") - GRAM + 1, 1).otherwise(0)).alias("wholes"),
        F.min(F.when(F.col("n") == F.col("size") - GRAM + 1, F.col("first"))).alias("first_whole"), F.max(F.when(F.col("n") == F.col("size") - GRAM + 1, F.col("first"))).alias("last_whole"),
    )
    return merged.withColumn("score", F.col("covered") / F.col("size")).withColumn("last", F.col("last_run") + GRAM - 1)


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    base, accepted = F.col("is_base") & (F.col("wholes") > 0), F.col("score") >= MIN_COVERAGE
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    # A base label needs the whole phrase; part of a base phrase is no evidence of its own.
    texts = cut_texts(docs)
    found = spans(votes(texts)).groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).agg(
        F.sum(F.when(F.col("is_base"), F.col("wholes"))).alias("n_base"), F.min(F.when(F.col("is_base"), F.col("first_whole"))).alias("first_word"), F.max(F.when(F.col("is_base"), F.col("last_whole"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | (accepted & ~F.col("is_base"))).alias("labels"), F.max(F.when(~F.col("is_base") | base, F.col("score"))).alias("score"),
    )
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
