"""License scans by diagonal voting.

Every rolling k-gram of every text is hashed and joined to the positions of the k-grams of known
licence texts; the joined words are compared, so a hash alone decides nothing. A pair of positions
votes for its diagonal, the difference of the two. Votes are summed by text, template and diagonal;
neighbouring diagonals merge, so that a word left out or added does not break a passage; a merged
span is verified by the part of the template that its votes cover and by its length.

The templates are a fixed short list, so their side of the join is broadcast whatever the corpus.
A base phrase is a template whose every word must stand consecutively on one diagonal.

Defined results: a null or empty text has no words, no labels and score 0. A row is known by its key
and a hash of its text, so rows that share a key keep apart and equal rows get equal results. Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

#: Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Passages of well-known licence texts and notices, with the method's labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-notice"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
)
#: Words of a gram of a template, and of a base phrase, which may be short.
GRAM = 4
BASE_GRAM = 2
#: Diagonals so near merge; a span must have this part of its template, and at most so many times its words.
NEAR = 3
LEAST_COVERED = 0.75
LONGEST_SPAN = 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row for each gram of each template: its words, its place, and what it belongs to. Fixed and small."""
    rows = []
    for is_base, entries, k in ((True, base, BASE_GRAM), (False, templates, GRAM)):
        for phrase, label in entries:
            words = phrase.split()
            assert k <= len(words) <= 60, phrase
            rows += [(is_base, label, phrase, len(words), k, at, words[at : at + k]) for at in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "is_base boolean, label string, phrase string, length int, k int, at int, gram array<string>")
    return table.withColumn("hash", gram_hash(F.col("gram"), F.lit(0), BASE_GRAM)).withColumn("hash", F.when(F.col("is_base"), F.col("hash")).otherwise(gram_hash(F.col("gram"), F.lit(0), GRAM)))


def gram_hash(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from ``at`` on; the number of words is part of it."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)], F.lit(k))


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, n_words) joined to templates: a row for each place of a text with a gram of a template.

    ``words`` stands beside the exploded places only within the stage of the join.
    """
    places = lambda k: F.transform(F.col("words"), lambda w, i: F.struct(i.alias("pos"), gram_hash(F.col("words"), i, k).alias("hash")))
    hashed = docs.select("row", "words", F.concat(places(BASE_GRAM), places(GRAM)).alias("places"))
    each = hashed.select("row", "words", F.explode("places").alias("p")).select("row", "words", "p.pos", "p.hash")
    same = (each["hash"] == grams["hash"]) & (F.slice(F.col("words"), F.col("pos") + 1, F.col("k")) == F.col("gram"))
    return each.join(F.broadcast(grams), same).select("row", "is_base", "label", "phrase", "length", "k", "at", F.col("pos").cast("long").alias("pos"))


def diagonals(found: DataFrame) -> DataFrame:
    """Votes summed by diagonal: first and last place, and the covered grams of the template as bits."""
    bit = F.expr("shiftleft(1L, at)")
    return (
        found.withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy("row", "is_base", "label", "phrase", "length", "k", "diagonal")
        .agg(F.bit_or(bit).alias("bits"), F.min("pos").alias("first"), (F.max("pos") + F.first("k")).alias("end"))
    )


def spans(diagonal: DataFrame) -> DataFrame:
    """Verified spans: (row, is_base, label, start, end, covered)."""
    whole = F.bit_count("bits") == F.col("length") - F.col("k") + 1
    exact = diagonal.filter(F.col("is_base") & whole).select("row", "is_base", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("covered"))
    line = Window.partitionBy("row", "phrase").orderBy("diagonal")
    begins = (F.col("diagonal") - F.lag("diagonal").over(line) > NEAR) | F.lag("diagonal").over(line).isNull()
    merged = (
        diagonal.filter(~F.col("is_base"))
        .withColumn("run", F.sum(begins.cast("long")).over(line))
        .groupBy("row", "label", "phrase", "length", "k", "run")
        .agg(F.bit_or("bits").alias("bits"), F.min("first").alias("start"), F.max("end").alias("end"))
    )
    #: Words under the covered grams: a gram reaches k - 1 words on.
    reached = F.col("bits")
    for step in range(1, GRAM):
        reached = reached.bitwiseOR(F.shiftleft(F.col("bits"), step))
    covered = F.bit_count(reached) / F.col("length")
    near = merged.withColumn("covered", covered).filter((F.col("covered") >= LEAST_COVERED) & (F.col("end") - F.col("start") <= LONGEST_SPAN * F.col("length")))
    return exact.unionByName(near.select("row", F.lit(False).alias("is_base"), "label", "start", "end", "covered"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    #: A generator of one row keeps the optimizer from splitting a text anew for each of its words.
    rows = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("sum")).alias("row"), F.explode(F.array(lowered_words(F.col(text)))).alias("words"))
    found = spans(settle(diagonals(votes(rows, template_grams(docs.sparkSession, templates, base)))))
    at = F.when(F.col("is_base"), F.col("start"))
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    summed = found.groupBy(F.col("row").alias("found")).agg(
        F.count(at).alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        listed(F.collect_set(F.when(F.col("is_base"), F.col("label")))).alias("base_labels"),
        listed(F.collect_set("label")).alias("labels"),
        F.max("covered").alias("score"),
    )
    joined = rows.select("row", F.size("words").cast("long").alias("n_words")).join(summed, F.col("row").eqNullSafe(F.col("found")), "left")
    return joined.select(
        F.col("row.key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
