"""License notices by diagonal voting, with DataFrame functions only.

A text's words roll by in windows of three (two for a phrase of two words). Each window is joined, by the hash of its first two words
and then the words themselves, to the places where it stands in the notices of TEMPLATES. A match at word p of the text and word t of a
notice votes for the diagonal p - t: a notice copied without change puts all its votes on one diagonal, one with words put in or left
out on a few neighbouring ones. Diagonals at most DRIFT apart are merged into a span, and a span is verified: it must hold LEAST of the
notice's words, and the notice's words must fill LEAST_FILL of it. The phrases asked for are notices of two or three words of which
every place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, texts

# Phrases and their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# Sentences of common license notices, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]
#: Words of a window, the distance of diagonals that are merged, and the shares a span is verified by.
WIDTH, DRIFT, LEAST, LEAST_FILL = 3, 4, 0.8, 0.5
#: What a phrase's place alone counts in the score.
PHRASE_SCORE = 0.5
_KEY = ["_id", "_sha", "_words"]


def words_of(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # in ASCII both are the same, and lower() is fast; beyond it, it changes other letters too
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.array_remove(F.split(small, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _windows(words: Column) -> Column:
    """(a, b, c) at every word: it and the two that follow, null beyond the end."""
    shifted = [F.slice(words, 1 + i, F.greatest(F.size(words), F.lit(1))).alias(n) for i, n in enumerate("abc")]
    return F.arrays_zip(*shifted)


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_windows(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(_notice, _label, _phrase, _length, _t, _pair, _a, _b, _c): a row for each window of each notice."""
    listed = [F.struct(F.lit(i).alias("_notice"), F.lit(label).alias("_label"), F.lit(i < len(phrases)).alias("_phrase"), F.lit(text).alias("_text")) for i, (label, text) in enumerate(phrases + templates)]
    rows = spark.range(1).select(F.inline(F.array(*listed)))
    rows = rows.withColumn("_list", words_of(F.col("_text"))).withColumn("_length", F.size("_list"))
    rows = rows.select("_notice", "_label", "_phrase", "_length", F.posexplode(_windows(F.col("_list"))).alias("_t", "_w"))
    whole = (F.col("_t") == 0) | (F.col("_t") + WIDTH <= F.col("_length"))  # a notice shorter than a window is one window
    return rows.where(whole).select("_notice", "_label", "_phrase", "_length", "_t", _pair(F.col("_w.a"), F.col("_w.b")).alias("_pair"), *[F.col(f"_w.{n}").alias(f"_{n}") for n in "abc"])


def _matches(docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """Votes by (_KEY, _notice, _label, _phrase, _length, _diagonal), and a row without a notice for each text, with its rows in _copies.

    Rows that repeat both id and text are one text here.
    """
    rows = texts(docs).select("_id", F.sha2("_text", 256).alias("_sha"), words_of(F.col("_text")).alias("_list"))
    rows = rows.select("_id", "_sha", F.size("_list").cast("bigint").alias("_words"), _windows(F.col("_list")).alias("_zip"))
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in "abc"]))  # stands for the text itself, so none is lost
    rolled = rows.select(*_KEY, F.posexplode(F.concat(none, "_zip")).alias("_at", "_w"))
    rolled = rolled.select(*_KEY, (F.col("_at") - 1).alias("_p"), *[F.col(f"_w.{n}").alias(f"_x{n}") for n in "abc"])
    known = F.broadcast(template_windows(docs.sparkSession, phrases, templates))  # as many rows as the notices have words
    same = (_pair(F.col("_xa"), F.col("_xb")) == F.col("_pair")) & (F.col("_xa") == F.col("_a")) & (F.col("_xb") == F.col("_b")) & (F.col("_c").isNull() | (F.col("_xc") == F.col("_c")))
    hits = rolled.join(known, same, "left").where("_p < 0 or _notice is not null")
    votes = hits.groupBy(*_KEY, "_notice", "_label", "_phrase", "_length", (F.col("_p") - F.col("_t")).alias("_diagonal"))
    return votes.agg(F.collect_set("_t").alias("_votes"), F.min("_p").alias("_first"), F.max("_p").alias("_last"), F.sum(F.when(F.col("_p") < 0, 1)).alias("_copies"))


def _spans(matches: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged and verified: (_KEY, _label, _phrase, _copies, _first, _past, _share)."""
    notice = [*_KEY, "_notice", "_label", "_phrase", "_length"]
    along = Window.partitionBy(*_KEY, "_notice").orderBy("_diagonal")
    # every place of a phrase counts, so its diagonals stay apart
    apart = F.col("_phrase") | (F.col("_diagonal") - F.lag("_diagonal").over(along) > DRIFT)
    merged = matches.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_span", F.sum("_new").over(along))
    merged = merged.groupBy(*notice, "_span").agg(
        F.flatten(F.collect_set("_votes")).alias("_t"), F.sum(F.size("_votes")).alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_copies").alias("_copies")
    )
    width = F.least(F.lit(WIDTH), F.col("_length"))
    # the words that matched windows cover
    covered = F.size(F.array_distinct(F.flatten(F.transform("_t", lambda t: F.sequence(t, t + width - 1)))))
    merged = merged.withColumn("_past", F.col("_last") + width).withColumn("_share", F.when(F.col("_length").isNotNull(), covered / F.col("_length")))
    fill = (F.col("_n") + width - 1) / (F.col("_past") - F.col("_first"))
    right = F.col("_notice").isNull() | F.col("_phrase") | ((F.col("_share") >= LEAST) & (fill >= LEAST_FILL))
    return merged.where(right)


def license_spans(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, label, phrase, first_word, past_word, share): every verified span of ``docs`` (doc_id, text), words from 0.

    Rows that repeat both id and text give their spans once.
    """
    found = _spans(_matches(docs, phrases, templates)).where("_notice is not null")
    return found.select(id_or_none("_id").alias("doc_id"), F.col("_label").alias("label"), F.col("_phrase").alias("phrase"), F.col("_first").alias("first_word"), F.col("_past").alias("past_word"), F.col("_share").alias("share"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs`` (doc_id, text).

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the first and last of them (null without one);
    ``base_labels`` are those of phrases, ``labels`` of phrases and verified spans. The score is the largest share of a notice
    that a verified span holds, at least PHRASE_SCORE with a phrase, else 0. Null text counts as empty and has neither; null and
    repeated ids give a row each; other columns are ignored; an empty table gives an empty table.
    """
    spans = _spans(_matches(docs, phrases, templates))
    phrase, joined = F.col("_phrase"), lambda c: F.array_join(F.array_sort(c), ",")
    first = F.when(phrase, F.col("_first"))
    out = spans.groupBy(*_KEY).agg(
        F.max("_copies").alias("_copies"),
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(first).cast("bigint").alias("first_word"),
        F.max(first).cast("bigint").alias("last_word"),
        joined(F.collect_set(F.when(phrase, F.col("_label")))).alias("base_labels"),
        joined(F.collect_set("_label")).alias("labels"),
        F.greatest(F.coalesce(F.max(F.when(~phrase, F.col("_share"))), F.lit(0.0)), F.when(F.count(F.when(phrase, 1)) > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
    )
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    return out.select(id_or_none("_id").alias("doc_id"), F.col("_words").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def sql() -> str:
    """The same in SQL, over whole lists of notices: windows by their words, diagonals, merged spans, shares."""
    listed = ", ".join(f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, '{text}')" for i, (label, text) in enumerate(PHRASES + TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
t AS (SELECT notice, label, phrase, string_split(text, ' ') AS ws FROM (VALUES {listed}) v(notice, label, phrase, text)),
tw AS (
  SELECT notice, label, phrase, len(ws) AS length, least({WIDTH}, len(ws)) AS k, x - 1 AS t, array_to_string(ws[x:x + least({WIDTH}, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least({WIDTH}, len(ws)) + 2)) AS x FROM t)),
dw AS (
  SELECT i, k, x - 1 AS p, array_to_string(ws[x:x + k - 1], ' ') AS g
  FROM (SELECT i, ws, k, unnest(range(1, len(ws) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM tw) WHERE len(ws) >= k)),
m AS (
  SELECT i, notice, label, phrase, length, tw.k, p - t AS diagonal, list(DISTINCT t) AS votes, min(p) AS first, max(p) AS last
  FROM dw JOIN tw ON dw.k = tw.k AND dw.g = tw.g GROUP BY i, notice, label, phrase, length, tw.k, p - t),
n AS (
  SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY i, notice ORDER BY diagonal) > {DRIFT} THEN 1 ELSE 0 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY i, notice ORDER BY diagonal) AS span FROM n),
c AS (
  SELECT i, notice, label, phrase, length, k, span, flatten(list(votes)) AS t, sum(len(votes)) AS n, min(first) AS first, max(last) + k AS past
  FROM s GROUP BY i, notice, label, phrase, length, k, span),
v AS (
  SELECT *, len(list_distinct(flatten(list_transform(t, lambda y: range(y, y + k))))) / length AS share FROM c),
r AS (SELECT * FROM v WHERE phrase OR (share >= {LEAST} AND (n + k - 1) / (past - first) >= {LEAST_FILL})),
g AS (
  SELECT i, count(*) FILTER (WHERE phrase) AS n_base, min(first) FILTER (WHERE phrase) AS first_word, max(first) FILTER (WHERE phrase) AS last_word,
    list_sort(list(DISTINCT label) FILTER (WHERE phrase)) AS base_labels, list_sort(list(DISTINCT label)) AS labels, max(share) FILTER (WHERE NOT phrase) AS share
  FROM r GROUP BY i)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
  CAST(greatest(coalesce(share, 0), CASE WHEN coalesce(n_base, 0) > 0 THEN {PHRASE_SCORE} ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN g ON d.i = g.i"""
