"""License scans by diagonal voting.

All rolling word pairs of a text are hashed and joined to the places of the same pairs in the templates. A pair at word
``p`` of the text and word ``t`` of a template votes for the diagonal ``p - t``, the place where the template would
start. Votes are added up by diagonal as a bit mask of the template words they cover; diagonals of one template that lie
at most SLACK words apart (words were put in or left out) are merged; a span is verified when its votes, which were
compared word by word, cover enough of the template. Everything is DataFrame operations; the templates are a fixed list,
so the join is a broadcast and only the votes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.llm.common import keyed_texts
from flowlab.session import materialize

#: Words, after A-Z are lower-cased: everything but ASCII signs and controls.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals of one template at most this many words apart are one span.
SLACK = 3
#: Share of a notice's words that a span must cover.
COVERED = 0.8
#: A mask is one long: no template has more words.
MOST_WORDS = 62
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases whose every place counts.
PHRASES = [
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("gpl", "gnu general public license"),
    ("mit", "mit license"),
]

#: Notices of common licenses, as words.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _numbered() -> list[tuple[int, bool, str, str]]:
    named = [(True, *x) for x in PHRASES] + [(False, *x) for x in NOTICES]
    return [(k, base, label, text) for k, (base, label, text) in enumerate(named)]


def _values() -> str:
    return ", ".join(f"({k}, {str(base).lower()}, '{label}', '{text}')" for k, base, label, text in _numbered())


def templates(spark: SparkSession) -> DataFrame:
    """(template, base, label, length) of the fixed phrases and notices."""
    listed = spark.sql(f"SELECT * FROM VALUES {_values()} AS t(template, base, label, words)")
    return listed.select("template", "base", "label", F.split("words", " ").alias("words")).withColumn("length", F.size("words"))


def _pair_hash(one: Column, two: Column) -> Column:
    return F.xxhash64(one, two)


def _pairs(words: Column) -> Column:
    """(at, hash, one, two) for each word and its follower; the last word's follower is null and matches nothing."""

    def pair(word: Column, at: Column) -> Column:
        two = F.get(words, at + 1)
        return F.struct(at.alias("at"), _pair_hash(word, two).alias("hash"), word.alias("one"), two.alias("two"))

    return F.transform(words, pair)


def votes(texts: DataFrame) -> DataFrame:
    """(id, th, n_words, at, template, place): each vote, and one row per input row whose template is null."""
    lowered = F.translate("text", _UPPER, _LOWER)
    listed = texts.select("id", "th", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    pairs = listed.select("id", "th", F.size("words").cast("long").alias("n_words"), F.explode_outer(_pairs(F.col("words"))).alias("p"))
    places = templates(texts.sparkSession).select("template", F.explode(_pairs(F.col("words"))).alias("t")).filter("t.two IS NOT NULL")
    same = (F.col("p.hash") == F.col("t.hash")) & (F.col("p.one") == F.col("t.one")) & (F.col("p.two") == F.col("t.two"))
    met = pairs.join(F.broadcast(places), same, "left")  # the templates are a fixed list of a few hundred pairs
    row = F.col("p.at").isNull() | (F.col("p.at") == F.col("n_words") - 1)  # no word, or the last one: once per text
    return met.filter(F.col("template").isNotNull() | row).select("id", "th", "n_words", F.col("p.at").alias("at"), "template", F.col("t.at").alias("place"))


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (id, th, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places of the phrases, first_word and last_word are their smallest and largest start; base_labels
    and labels (with those of the verified notices) are distinct, sorted and comma-joined; score is the largest share of
    a template that one span covers. A text without words (null, empty, signs only) has no place, empty labels and score
    0; repeated rows get equal results; an empty table gives no rows; a null id stays ``NO_ID``. Columns other than the
    two named ones are not read. A text of any length is one row of pairs after another; repeated rows, however many,
    are reduced to one mask per diagonal before the shuffle.
    """
    cast = materialize(votes(keyed_texts(df, doc_id, text)), "votes")
    rows = cast.filter("template IS NULL").select("id", "th", "n_words")
    listed = F.broadcast(templates(df.sparkSession).select("template", "base", "label", "length"))
    key = ["id", "th", "template"]
    ends = F.expr("shiftleft(3L, place)")  # both words of the pair
    diagonals = cast.filter("template IS NOT NULL").groupBy(*key, (F.col("at") - F.col("place")).cast("long").alias("diagonal")).agg(F.bit_or(ends).alias("mask"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > SLACK
    spans = diagonals.withColumn("new", F.coalesce(apart.cast("long"), F.lit(0))).withColumn("span", F.sum("new").over(along))
    spans = spans.join(listed, "template").withColumn("whole", F.col("base") & (F.bit_count("mask") == F.col("length")))
    spans = spans.groupBy(*key, "span", "base", "label", "length").agg(
        F.count_if("whole").alias("places"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        (F.bit_count(F.bit_or("mask")) / F.col("length")).alias("share"),
    )
    found = F.when(F.col("places") > 0, F.col("label"))
    noticed = F.when(~F.col("base") & (F.col("share") >= COVERED), F.col("label"))
    texts = spans.groupBy("id", "th").agg(
        F.sum("places").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.collect_set(found).alias("base_set"),  # at most one entry per label
        F.collect_set(F.coalesce(found, noticed)).alias("set"),
        F.max("share").alias("score"),
    )
    return rows.join(texts, ["id", "th"], "left").select(
        "id",
        "th",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join(F.array_sort("base_set"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("set"), ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


#: The same in DuckDB SQL, over the view ``documents``.
SQL_LICENSES = rf"""
WITH tpl(template, base, label, words) AS (VALUES {_values()}),
tw AS (SELECT template, base, label, string_split(words, ' ') AS ws FROM tpl),
tp AS (
  SELECT template, ws[i + 1] AS one, ws[i + 2] AS two, i AS place
  FROM (SELECT template, ws, unnest(range(0, len(ws) - 1)) AS i FROM tw)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws[i + 1] AS one, ws[i + 2] AS two, i FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 1)) AS i FROM d)),
diag AS (
  SELECT doc_id, template, i - place AS diagonal, bit_or((3::BIGINT) << place::BIGINT) AS mask
  FROM p JOIN tp USING (one, two) GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS new
  FROM diag),
spanned AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
joined AS (SELECT s.*, base, label, len(ws) AS n, base AND bit_count(mask) = len(ws) AS whole FROM spanned AS s JOIN tw USING (template)),
spans AS (
  SELECT doc_id, template, base, label, span, count(*) FILTER (WHERE whole) AS places,
         min(diagonal) FILTER (WHERE whole) AS first_word, max(diagonal) FILTER (WHERE whole) AS last_word,
         bit_count(bit_or(mask)) / n::DOUBLE AS share
  FROM joined GROUP BY doc_id, template, base, label, span, n),
texts AS (
  SELECT doc_id, sum(places) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0 OR NOT base AND share >= {COVERED}) AS labels,
         max(share) AS score
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN texts USING (doc_id)"""
