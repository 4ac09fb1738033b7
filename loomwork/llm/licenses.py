"""License scans by diagonal voting, on DataFrame functions alone.

Texts and templates are words. Every run of K words of every text is hashed and joined to the positions at which
the templates hold it. A match at word i of a text and word j of a template votes for the diagonal i - j; runs of
votes on one diagonal are segments, segments on neighbouring diagonals merge, and the words of a merged span are
then compared with the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, table

#: Words in a rolling run. The shortest phrases have two.
K = 2
#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own templates: usual opening sentences of licenses and notices. A span needs `share` of the words.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved",
}
#: Least share of a template's words that a verified span holds, and how far apart merged diagonals may lie.
SHARE, APART = 0.8, 2

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of ASCII letters, digits and all that is beyond ASCII."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.split(F.trim(spaced), " ")


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """Positions of the templates' runs: gram, label, exact, n (words), words, at. As many rows as the templates have words."""
    t = spark.createDataFrame(templates, "label string, phrase string, exact boolean").withColumn("t_words", F.split("phrase", " "))
    t = t.select(F.col("label"), "exact", "t_words", F.size("t_words").alias("n"))
    return t.select("*", F.posexplode(_grams(F.col("t_words"))).alias("at", "gram"))


def _grams(words: Column) -> Column:
    """Hashes of all runs of K words, in order."""
    last = F.size(words) - K
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(K))))).otherwise(F.array().cast("array<bigint>"))


def license_spans(docs: DataFrame, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """Verified spans: row, label, exact, first, last (words, inclusive), score.

    docs: row, words. templates: label, phrase, and whether only the whole phrase counts. A span of an exact
    template is a place where all its words stand consecutively, and each place counts on its own; of another
    template it may have gaps, extra or changed words, so long as SHARE of the template's words are there. A
    text without words has no spans.
    """
    grams = template_grams(docs.sparkSession, templates)
    same = [F.get("words", F.col("i") + k) == F.get("t_words", F.col("at") + k) for k in range(K)]
    votes = (
        docs.select("row", "words", F.posexplode(_grams(F.col("words"))).alias("i", "gram"))
        .join(F.broadcast(grams), "gram")  # as many rows as the templates have words
        .where(same[0] & same[1])  # the words themselves, not just their hash
        .select("row", "label", "exact", "n", "i", "at", (F.col("i") - F.col("at")).alias("diagonal"))
    )
    # On one diagonal a template position votes once at most.
    diagonals = votes.groupBy("row", "label", "exact", "n", "diagonal").agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.collect_list("at").alias("at")
    )
    whole = diagonals.where(F.col("exact") & (F.size("at") == F.col("n") - K + 1))
    spans = whole.select("row", "label", "exact", F.col("i0").alias("first"), (F.col("i1") + K - 1).alias("last"), F.lit(1.0).alias("score"))
    # Neighbouring diagonals merge while they lie APART or less from each other.
    by = Window.partitionBy("row", "label").orderBy("diagonal")
    merged = (
        diagonals.where("NOT exact")
        .withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > APART).cast("int"), F.lit(1)))
        .withColumn("part", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "label", "exact", "n", "part")
        .agg(F.min("i0").alias("first"), (F.max("i1") + K - 1).alias("last"), F.flatten(F.collect_list("at")).alias("at"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.array(*(x + k for k in range(K)))))))
    merged = merged.withColumn("score", covered / F.col("n")).where(F.col("score") >= SHARE)
    return spans.unionByName(merged.select("row", "label", "exact", "first", "last", "score"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text of documents.

    Nulls count as empty texts, repeated rows stay apart. score is the best share of a template's words that a
    span holds, 0 without spans.
    """
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    n_words = F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")).cast("long")
    phrases = [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, phrase, False) for label, phrase in TEMPLATES.items()]
    spans = license_spans(docs.select("row", "words"), phrases)
    base = F.col("exact")
    found = spans.groupBy(F.col("row").alias("of")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    return docs.select("row", "doc_id", n_words.alias("n_words")).join(found, F.col("row") == F.col("of"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
