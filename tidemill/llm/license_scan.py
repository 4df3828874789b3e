"""Licence scan by diagonal voting, in DataFrame functions only.

Every text becomes words; every rolling pair of words is hashed and joined to the
positions at which the template library holds the same pair. A template that
stands in a text puts all its votes on one diagonal (text position minus template
position); an inserted or missing word moves the rest to a neighbouring diagonal.
Votes are counted by diagonal, neighbouring diagonals are merged, and a merged
span is verified: enough of the template, in a stretch not much longer than it.

Defined results. Null text: no words, nothing found. A null ``doc_id`` is a value
like any other. Rows that repeat both ``doc_id`` and text give one result row
each. Texts of any length are read whole. An empty table gives no rows. Of spans that
cover as much, all count. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import WHOLE

K = 2
UPPER = string.ascii_uppercase
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: label -> phrase whose every exact place counts
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: label -> texts of which a large part must stand together
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa", "creative commons attribution sharealike"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "lgpl": ["gnu lesser general public license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
MIN_COVER, SLACK = 0.75, 3

#: pairs of two of these words stand in every text and cast no vote for a label of the method
FUNCTION = frozenset("a and any are as be by for in is not of or that the this to with".split())


def template_rows() -> list[tuple]:
    """(tid, label, base, n_grams, tpos, first word, second word): about a thousand, fixed by this subpackage."""
    rows, tid = [], 0
    for base, library in ((True, {k: [v] for k, v in BASE.items()}), (False, TEMPLATES), (False, {k: [v] for k, v in WHOLE.items()})):
        for label, texts in library.items():
            for text in texts:
                words = re.findall(WORD, text.lower())
                places = [i for i in range(len(words) - K + 1) if base or not FUNCTION.issuperset(words[i : i + K])]
                rows += [(tid, label, base, len(places), i, words[i], words[i + 1]) for i in places]
                tid += 1
    return rows


def template_positions(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame(template_rows(), "tid int, label string, base boolean, n_grams int, tpos int, t0 string, t1 string")
    return t.withColumn("h", F.xxhash64("t0", "t1"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias("fp"), F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)).alias("words"))
    grams = words.select("doc_id", "fp", "words", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "w0"))
    grams = grams.withColumn("w1", F.get("words", F.col("pos") + 1)).drop("words")
    grams = grams.withColumn("gram", F.xxhash64("w0", "w1"))
    # The library is a constant of this module, so broadcasting it is safe at any input size.
    lib = F.broadcast(template_positions(spark))
    hits = grams.join(lib, (F.col("gram") == F.col("h")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")), "left")
    # The last word of each text always passes and carries the word count.
    hits = hits.where("tid is not null or pos is null or pos = n - 1").select(
        "doc_id", "fp", "n", "tid", "label", "base", "n_grams", "tpos", F.when(F.col("tid").isNotNull(), F.col("pos") - F.col("tpos")).alias("diagonal"), "pos"
    )
    # One exchange serves all the grouping below, for each groups on these two and more.
    hits = hits.repartition("doc_id", "fp")
    votes = hits.groupBy("doc_id", "fp", "tid", "label", "base", "n_grams", "diagonal").agg(
        F.max("n").alias("n"),
        F.collect_set("tpos").alias("held"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.sum(F.when(F.col("tid").isNull() | (F.col("pos") == F.col("n") - 1), 1).otherwise(0)).alias("copies"),
    )
    # A phrase stands exactly where its diagonal holds all its votes; the method's own templates may merge diagonals.
    votes = votes.where("tid is null or (base and size(held) = n_grams) or (not base and size(held) >= least(2, n_grams))")
    by_template = Window.partitionBy("doc_id", "fp", "tid").orderBy("diagonal")
    # Neighbouring diagonals keep votes near each other, as a template's places are; the span's length is verified below.
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_template) > SLACK)
    votes = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(by_template))
    spans = votes.groupBy("doc_id", "fp", "tid", "label", "base", "n_grams", "span").agg(
        F.max("n").alias("n"),
        F.max("copies").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("diagonal").alias("diagonal"),
    )
    cover = F.size("held") / F.col("n_grams")
    sound = F.col("tid").isNotNull() & (F.col("base") | ((cover >= MIN_COVER) & (F.col("hi") - F.col("lo") + 1 <= 2 * F.col("n_grams") + SLACK)))
    spans = spans.withColumn("sound", sound).withColumn("cover", F.when(sound, cover))
    base = F.col("sound") & F.col("base")
    # Labels are few and fixed, so these sets are small whatever the text.
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "fp").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("sound")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("sound") & ~F.col("base"), F.struct("lo", F.expr(f"hi + {K} as end"), "label")))).alias("spans"),
        F.max(F.when(F.col("tid").isNull(), F.col("copies"))).alias("copies"),
    )
    # Size(null-safe): an empty text has n = 0 from the outer explode.
    out = out.withColumn("n_words", F.greatest("n_words", F.lit(0).cast("long")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))).drop("fp", "copies", "copy")
