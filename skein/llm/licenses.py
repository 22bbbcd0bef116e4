"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words of every text is joined by its hash to its positions in the templates (a
table of fixed size, so it is broadcast; the words themselves are compared as well). Hits vote for their
diagonal, document position minus template position. A base phrase stands where its diagonal has all
votes; for longer templates neighbouring diagonals are merged, which allows for words put in or left
out, and a merged span counts if enough different pairs of the template voted for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Well-known wordings and the labels that this method adds.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
)
NEIGHBOURS = 2
COVERAGE = 0.7
MOST = 65  # words of a template: its votes are the bits of a long
#: Fixed value: what a word is made of, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pairs(spark: SparkSession) -> DataFrame:
    rows = []
    for number, (phrase, label) in enumerate((*BASE, *TEMPLATES)):
        words = phrase.split(" ")
        if not 2 <= len(words) <= MOST:
            raise ValueError(f"a template has 2 to {MOST} words: {phrase}")
        rows += [(number, label, number < len(BASE), len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, tpos int, t1 string, t2 string")
    return table.withColumn("h", F.xxhash64("t1", "t2"))


def scan(documents: DataFrame) -> DataFrame:
    """Base phrases and license templates in each whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best
    coverage of a template or phrase found, else 0). Null and empty texts have no words; rows with null
    or repeated doc_id are scanned like any other; empty tables give no rows; further columns are
    ignored. No label is the empty string.
    """
    spark = documents.sparkSession
    # lower() would turn two other characters into ASCII letters; they stay outside ASCII here
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u03c9")), F.lit("\u0130"), F.lit("\u0131"))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    spots = df.withColumn("p", F.explode_outer(F.when(F.col("n_words") > 1, F.sequence(F.lit(0), F.size("words") - 2))))
    spots = spots.select("rid", "doc_id", "n_words", "p", F.get("words", F.col("p")).alias("w1"), F.get("words", F.col("p") + 1).alias("w2"))
    hits = spots.join(F.broadcast(_pairs(spark)), (F.xxhash64("w1", "w2") == F.col("h")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    row = ["rid", "doc_id", "n_words"]
    diagonals = hits.groupBy(*row, "template", "label", "base", "pairs", (F.col("p") - F.col("tpos")).alias("diagonal")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tpos"))).alias("votes"))
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    opens = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS)
    spans = diagonals.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(along))
    spans = spans.groupBy(*row, "template", "label", "base", "pairs", "span").agg(F.bit_count(F.bit_or("votes")).alias("met"), F.min("diagonal").alias("at"))
    spans = spans.withColumn("cover", F.col("met") / F.col("pairs"))
    placed = F.col("base") & (F.col("met") == F.col("pairs"))
    named = placed | (~F.col("base") & (F.col("cover") >= COVERAGE))
    place = F.when(placed, F.col("at").cast("long"))
    return spans.groupBy(*row).agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(placed, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(named, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("rid")
