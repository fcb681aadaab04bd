"""License scan by diagonal voting, in DataFrame operations only.

Every word 3-gram of every text is hashed and joined with the positions of the same
grams in the templates, a fixed list in this module (the broadcast side is its size).
A hit votes for the diagonal ``position in the text - position in the template``; votes
are aggregated by diagonal, diagonals at most :data:`NEAR` apart are merged, and the
merged span is verified: by its share of the template's grams and by its extent. A base
phrase counts where its diagonal is complete, which is where its words stand in a row.

Grams are compared by their words behind the hash, so equal hashes alone never count.
Null and empty texts have no word. Repeated rows (equal id and text) get equal results;
rows that share only their id are scanned apart. Further columns are ignored, a null id
is kept as it is, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals so near belong to one occurrence with words put in or left out.
NEAR = 4
#: The least share of a template's grams, and the most words of its span against its own.
LEAST_SHARE, MOST_EXTENT = 0.6, 1.5

# Base phrases with their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Notices of public licenses with their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. The Kelvin sign, whose lower case is k, must not become a letter of A-Z."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _grams(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each 3-gram of the array ``w``: its position, words and hash."""
    zipped = F.arrays_zip("w", F.expr("slice(w, 2, greatest(size(w) - 2, 0))").alias("x"), F.expr("slice(w, 3, greatest(size(w) - 2, 0))").alias("y"))
    rows = df.where("size(w) >= 3").select(*keys, F.posexplode(F.slice(zipped, F.lit(1), F.expr("size(w) - 2"))).alias("at", "g"))
    return rows.select(*keys, "at", F.col("g.w").alias("a"), F.col("g.x").alias("b"), F.col("g.y").alias("c")).withColumn("hash", F.xxhash64("a", "b", "c"))


def _templates(spark: SparkSession) -> DataFrame:
    listed = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    made = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for i, (label, text, base) in enumerate(listed)))
    rows = spark.range(1).select(F.inline(made)).withColumn("w", words(F.col("text"))).withColumn("length", F.size("w"))
    return _grams(rows, "template", "label", "base", "length").withColumnRenamed("at", "place")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of each row."""
    rows = narrow(docs, id=id_col, text=text_col).withColumn("mark", F.xxhash64("text"))
    key = ["id", "mark"]
    split = rows.select(*key, words(F.col("text")).alias("w"))
    t = F.broadcast(_templates(docs.sparkSession)).alias("t")
    g = _grams(split, *key).alias("g")
    same = (F.col("g.hash") == F.col("t.hash")) & (F.col("g.a") == F.col("t.a")) & (F.col("g.b") == F.col("t.b")) & (F.col("g.c") == F.col("t.c"))
    votes = g.join(t, same).select("g.id", "g.mark", "t.template", "t.label", "t.base", "t.length", "g.at", "t.place", (F.col("g.at") - F.col("t.place")).alias("diagonal"))
    diagonals = votes.groupBy(*key, "template", "label", "base", "length", "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    # a place of a base phrase is a diagonal of its own; diagonals of a notice that lie near each other are one span
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    fresh = F.when(~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR), 0).otherwise(1)
    merged = diagonals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line))
    spans = merged.groupBy(*key, "template", "label", "base", "length", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal")
    )
    share = F.col("hits") / (F.col("length") - 2)
    like = (F.col("share") >= LEAST_SHARE) & (F.col("high") - F.col("low") + 3 <= MOST_EXTENT * F.col("length"))
    found = spans.withColumn("share", share).where(F.when(F.col("base"), F.col("hits") == F.col("length") - 2).otherwise(like))
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    results = found.groupBy(*key).agg(
        F.count(of_base("diagonal")).alias("n_base"), F.min(of_base("diagonal")).alias("first_word"), F.max(of_base("diagonal")).alias("last_word"),
        F.collect_set(of_base("label")).alias("base_set"), F.collect_set("label").alias("label_set"), F.max("share").alias("share"),
    )
    none = F.array().cast("array<string>")
    out = rows.select(*key, F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d").join(
        results.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.mark") == F.col("r.mark")), "left"
    )
    listed = lambda found: F.array_join(F.array_sort(F.coalesce(found, none)), ",")
    return out.select(
        F.col("d.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        listed(F.col("base_set")).alias("base_labels"), listed(F.col("label_set")).alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),  # a base phrase has a share of 1
    )
